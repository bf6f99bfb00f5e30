"""Names of mate and output files from one name."""

from __future__ import annotations

import os

# fixed values: what stands for the first and the second mate, in the order of trial; known extensions
MATES = [("_R1_", "_R2_"), ("_f", "_r"), (".f", ".r"), ("_1", "_2"), (".1", ".2")]
EXTENSIONS = [".fq", ".fastq", ".txt", ".gz", ".bz2", ".zip"]


def split_extensions(name: str) -> tuple[str, str]:
    """The name without its known extensions, and these."""
    core = name
    while hit := next((e for e in EXTENSIONS if core.endswith(e)), None):
        core = core[: -len(hit)]
    return core, name[len(core) :]


def mate_path(path: str) -> str:
    """The second mate's file: the last place of the first rule that fits is replaced."""
    folder, name = os.path.split(path)
    core, rest = split_extensions(name)
    for one, two in MATES:
        at = core.rfind(one)
        if at >= 0:
            return os.path.join(folder, core[:at] + two + core[at + len(one) :] + rest)
    raise ValueError(f"no mate can be named for {path}")


def output_paths(path: str) -> dict[str, str]:
    """The four outputs of a paired run."""
    folder, name = os.path.split(path)
    core, rest = split_extensions(name)
    return {k: os.path.join(folder, f"{core}_{k}{rest}") for k in ("1P", "1U", "2P", "2U")}
