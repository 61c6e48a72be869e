"""Converters that hang, end their process or raise."""

from foliant.operators.convert import convert_corpus


def awkward():
    """Made here, so that workers get it by value."""

    def convert(content: bytes):
        import os
        import time

        text = content.decode()
        if text == "hang":
            while True:
                time.sleep(0.05)
        if text == "exit":
            os._exit(3)
        if text == "raise":
            raise ValueError("no")
        return text.upper(), f"<p>{text}</p>"

    return convert


def test_no_document_ends_the_run(spark):
    texts = ["a", "hang", "b", "exit", "c", "raise", "d", "", None]
    docs = spark.createDataFrame([(i, None if t is None else t.encode()) for i, t in enumerate(texts)], "doc_id long, content binary").coalesce(1)
    got = {int(r.doc_id): r for r in convert_corpus(docs, "e", awkward(), deadline_s=1).collect()}
    assert [got[i].status for i in range(9)] == ["available", "failed", "available", "failed", "available", "failed", "available", "missing_input", "missing_input"]
    assert [got[i].text for i in (0, 2, 4, 6)] == ["A", "B", "C", "D"]
    assert got[1].error.startswith("TimeoutError") and got[3].error == "ProcessEnded: exit code 3" and got[5].error == "ValueError: no"
    assert [i for i in range(9) if got[i].quarantined] == [1, 3]
    again = {int(r.doc_id): r for r in convert_corpus(docs, "e", awkward(), deadline_s=60, quarantine=spark.createDataFrame([(1,), (3,)], "doc_id long")).collect()}
    assert [again[i].error for i in (1, 3)] == ["quarantined"] * 2 and again[2].text == "B"


def test_no_converter(spark):
    docs = spark.createDataFrame([(1, b"x")], "doc_id long, content binary")
    assert convert_corpus(docs, "e", None).first().status == "missing_tool"
