"""Idempotent sinks: sheets, guarded CSV, webhooks, retention of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import spreadsheet_safe


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with every row of the keys in ``new`` replaced by the rows of ``new``; a foreign header fails closed."""
    if set(old.columns) != set(new.columns):
        raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(new.columns))}")
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def write_csv_guarded(df: DataFrame, path: str) -> None:
    """CSV whose text cells cannot act as formulas in a spreadsheet."""
    safe = [F.when(F.col(c).isNotNull(), spreadsheet_safe(F.col(c))).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", True).csv(path)


def fan_out(steps: list) -> callable:
    """A writer of micro-batches that hands each batch to every (name, step) in turn; a step that fails is noted and stops none of the others."""
    failures: list[tuple[int, str, str]] = []

    def write(df: DataFrame, batch: int) -> None:
        for name, step in steps:
            try:
                step(df, batch)
            except Exception as e:  # noqa: BLE001  a sink that fails must not take the others with it
                failures.append((batch, name, f"{type(e).__name__}: {e}"[:400]))

    write.failures = failures
    return write


def webhook(send, secret: str | None = None, retries: int = 2, pause: float = 1.0) -> callable:
    """A step for ``fan_out``: rows (url, body) sent by ``send(url, body, headers)`` from the tasks, signed with HMAC-SHA256, tried again after 1, 2, .. pauses."""
    def step(df: DataFrame, batch: int) -> None:
        def deliver(rows):
            import hashlib
            import hmac
            import time

            for row in rows:
                body = row["body"].encode()
                headers = {"X-Signature": "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()} if secret else {}
                for attempt in range(retries + 1):
                    try:
                        send(row["url"], body, headers)
                        break
                    except Exception:  # noqa: BLE001
                        if attempt == retries:
                            raise
                        time.sleep(pause * (attempt + 1))

        df.select("url", "body").foreachPartition(deliver)

    return step


def keep_newest(folder: str, n: int) -> list[str]:
    """Removes all but the n newest subfolders of a folder of debug artifacts; the names removed."""
    import os
    import shutil

    own = sorted((d for d in os.scandir(folder) if d.is_dir()), key=lambda d: (-d.stat().st_mtime, d.name))
    gone = [d.name for d in own[n:]]
    for name in gone:
        shutil.rmtree(os.path.join(folder, name))
    return gone
