"""Perplexity from an external program's report, and the pick of the latest result."""

from __future__ import annotations

import re
import shutil
import subprocess
from pathlib import Path

from ..errors import ModelError, UserError

ESTIMATE = re.compile(r"Final estimate:\s*PPL\s*=\s*([0-9.]+)")


def parse(report: str) -> float:
    m = ESTIMATE.search(report)
    if not m:
        raise ModelError("the report has no final estimate")
    return float(m[1])


def measure(program: str, weights: str, text: str, context: int = 2048, timeout: float = 36_000) -> float:
    """Runs the program on a text file (on the driver: one model file, one small held-out text)."""
    done = subprocess.run([program, "-m", weights, "-f", text, "-c", str(context)], capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode:
        raise ModelError(f"{Path(program).name} ended with {done.returncode}: {done.stderr.strip()[-300:]}")
    return parse(done.stdout + done.stderr)


def stored_weights(model: str, program: str = "ollama") -> str:
    """The weights' file of a model that the local server has: the first existing file that its model file is made FROM."""
    if not (found := shutil.which(program)):
        raise UserError(f"{program} isn't installed; name the weights' file")
    shown = subprocess.run([found, "show", "--modelfile", model], capture_output=True, text=True, check=False)
    names = [line.split(None, 1)[1].strip() for line in shown.stdout.splitlines() if re.match(r"FROM\s+\S", line)]
    if shown.returncode or not (files := [n for n in names if Path(n).is_file()]):
        raise UserError(f"{program} has no weights' file of {model}")
    return files[0]


def latest(runs: str, chosen: str | None = None) -> Path | None:
    """The chosen result file, or that of the lexically last run, or None."""
    if chosen is not None:
        if not Path(chosen).is_file():
            raise UserError(f"no file {chosen}")
        return Path(chosen)
    return max(Path(runs).glob("*/perplexidade.json"), default=None)
