"""The rule ``compilation``: what an external catalogue compiler says about whole files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MSGFMT = "/usr/bin/msgfmt"


def compile_files(files: DataFrame, command: str = MSGFMT, seconds: int = 60) -> DataFrame:
    """path, rule, severity, message for each (path, content) that ``command`` rejects, or that it can't be run on.

    The content goes to the compiler's standard input, so files need not be on the workers' disks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    done = subprocess.run([command, "--check-format", "-o", "/dev/null", "-"], input=bytes(content), capture_output=True, timeout=seconds, check=False)
                    said = None if done.returncode == 0 else done.stderr.decode("utf-8", "replace").strip()
                except (OSError, subprocess.TimeoutExpired) as e:
                    said = f"can't run {command}: {e}"
                if said is not None:
                    out.append((path, "compilation", "error", said or "compilation failed"))
            yield pd.DataFrame(out, columns=["path", "rule", "severity", "message"])

    return files.select("path", "content").mapInPandas(run, "path string, rule string, severity string, message string")
