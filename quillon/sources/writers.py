"""Writers. Tables go through Spark's writers; what one person reads (a run's description) is written by the driver."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line, null fields kept. Appended batches are files of their own, so a broken run loses one at most."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_review(df: DataFrame, path: str, order: str = "id") -> None:
    """The review table for spreadsheets: semicolons, a byte order mark, breaks inside quotes. One file, for people."""
    first = df.columns[0]
    named = df.orderBy(order).coalesce(1).withColumnRenamed(first, "﻿" + first)
    named.write.mode("overwrite").csv(path, header=True, sep=";", quote='"', escape='"', emptyValue="")


def write_metrics(df: DataFrame, path: str) -> None:
    """A small table as one CSV file; null is empty."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_held_out(df: DataFrame, path: str) -> None:
    """The one row of held_out_text as a text file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(df.first()["text"], encoding="utf-8")


def write_json(value, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def now_iso() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def new_run_id(*parts: str) -> str:
    return "_".join([datetime.now(UTC).strftime("%Y%m%d-%H%M%S"), *parts])


def run_log(folder: str) -> logging.Handler:
    """Sends the engine's log, which has ids, counts and hashes but no texts, to log.txt of a run."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(Path(folder, "log.txt"), encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logging.getLogger("quillon").addHandler(handler)
    return handler


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Numbers as people read them."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def summary_json(df: DataFrame) -> list[str]:
    return rounded(df, 4).toJSON().collect()


def plot_data(metrics: DataFrame) -> DataFrame:
    """(config, leitor, metrica, valor) of the bars that compare readers."""
    return metrics.select("config", "leitor", F.expr("stack(3, 'em', em, 'f1_tokens', f1_tokens, 'bertscore_f1', bertscore_f1) as (metrica, valor)"))


def recall_plot_data(metrics: DataFrame, k: int = 5) -> DataFrame:
    """(config, leitor, metrica, valor) of the bars that compare what retrieval finds; readings without retrieval have none."""
    bars = metrics.select("config", "leitor", F.expr(f"stack(2, 'recall_at_{k}', recall_at_{k}, 'mrr_at_{k}', mrr_at_{k}) as (metrica, valor)"))
    return bars.where("valor is not null")


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small table as people read it; null is a dash."""
    shown = rounded(df, digits)
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|")
    rows = [shown.columns, ["-"] * len(shown.columns), *([cell(v) for v in r] for r in shown.collect())]
    return "\n".join(f"| {' | '.join(r)} |" for r in rows) + "\n"
