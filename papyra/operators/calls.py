"""Calls of an injected model client page by page, with retries; failures are rows, never exceptions.

A client is a picklable function of (context, text) that returns text or raises. Spark's own task
retry is no substitute: it would repeat, and bill, a whole partition.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from papyra import fixed

Client = Callable[[str, str], str]
RESULT = "doc_id long, page_index int, output string, attempts int, error string, retryable boolean"
_RETRY = re.compile(fixed.RETRYABLE, re.I)
_AFTER = re.compile(r"retry.?after:?\s*(\d+)|wait\s+(\d+)\s*(?:s|sec)", re.I)


def delay_ms(attempt: int, message: str, initial: int = 1000, multiplier: int = 2, most: int = 30000) -> int:
    m = _AFTER.search(message)
    asked = int(m.group(1) or m.group(2)) * 1000 if m else 0
    return min(asked if 0 < asked < 300_000 else initial * multiplier**attempt, most)


def with_retry(call: Callable[[], str], retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None, bool]:
    """(output, attempts, error, retryable): a permanent error ends at once, others after retries more attempts."""
    for attempt in range(retries + 1):
        try:
            return call(), attempt + 1, None, False
        except Exception as e:
            message = f"{type(e).__name__}: {e}"
            again = bool(_RETRY.search(message))
            if not again or attempt == retries:
                return None, attempt + 1, message[:1024], again
            sleep(delay_ms(attempt, message) / 1000)
    return None, 0, None, False


def format_pages(pages: DataFrame, client: Client, retries: int = 3, stop_at_error: bool = False, tail: int = 200, wait: bool = True) -> DataFrame:
    """One row for each page (doc_id, page_index, text), in order within a document, documents side by side.

    The end of a page's output is the next page's context. After an error the document goes on, or
    its other pages are left out where stop_at_error is set. Null texts count as empty.
    """
    pause = time.sleep if wait else lambda s: None

    def step(b: pd.DataFrame) -> pd.DataFrame:
        context, rows = "", []
        for p in b.sort_values("page_index", kind="stable").itertuples():
            text = p.text if isinstance(p.text, str) else ""
            output, attempts, error, again = with_retry(lambda: client(context, text), retries, pause)  # noqa: B023
            rows.append((p.doc_id, p.page_index, output, attempts, error, again))
            if error and stop_at_error:
                break
            context = (output or context)[-tail:]
        return pd.DataFrame(rows, columns=["doc_id", "page_index", "output", "attempts", "error", "retryable"])

    return pages.select("doc_id", "page_index", "text").groupBy("doc_id").applyInPandas(step, RESULT)
