"""Retries and page-by-page calls; streams against their batch twins."""

import pytest

from papyra.operators import calls as ca
from papyra.plans.documents import echo_tail
from papyra.streaming import streams as st


def test_with_retry():
    pauses, left = [], [2]

    def sometimes() -> str:
        if left[0]:
            left[0] -= 1
            raise RuntimeError("429 retry after 7 s")
        return "ok"

    assert ca.with_retry(sometimes, 3, pauses.append) == ("ok", 3, None, False) and pauses == [7.0, 7.0]

    def never() -> str:
        raise ValueError("400 bad request")

    assert ca.with_retry(never, 3, pauses.append)[1:] == (1, "ValueError: 400 bad request", False)
    assert [ca.delay_ms(i, "") for i in range(6)] == [1000, 2000, 4000, 8000, 16000, 30000]


def test_format_pages(spark):
    def client(context: str, text: str) -> str:
        if text == "bad":
            raise ValueError("invalid")
        return f"[{context}]{text}"

    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "bad"), (1, 2, None), (2, 0, "x")], "doc_id long, page_index int, text string")
    got = {(r.doc_id, r.page_index): r for r in ca.format_pages(df, client, wait=False).collect()}
    assert got[1, 0].output == "[]a" and got[1, 1].error and got[1, 2].output == "[[]a]" and got[2, 0].output == "[]x"
    assert ca.format_pages(df, client, stop_at_error=True, wait=False).where("doc_id = 1").count() == 2


@pytest.mark.parametrize("files", [1, 3])
def test_stream_continuity_equals_batch(spark, tmp_path, files):
    df = spark.createDataFrame([(d, p, f"text {d} {p}") for d in range(5) for p in range(4)], "doc_id long, page_index int, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    stream = st.continuity(st.read_table_stream(spark, str(tmp_path), "pages", files), echo_tail)
    got = sorted(map(tuple, st.run_available(stream, "append", "test").drop("batch").collect()))
    assert got == sorted(map(tuple, st.continuity_batch(df, echo_tail).collect()))
