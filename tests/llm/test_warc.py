import pytest

from quillgrid.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, 1) for p, u, h in rows], "page_id long, url string, html string, digest int").repartition(3)


def test_round_trip(spark):
    big = "é<p>" * 40_000
    rows = [(i, f"http://x/{i}", f"<html>{i % 7}" + "x" * (i * 37)) for i in range(60)]
    rows += [(100, None, None), (101, "http://y", ""), (102, "u", big), (103, "u", big), (104, "u", big + "!"), (5, "again", "twice"), (5, "again", "twice"), (None, "n", "null id"), (105, "a\r\nb", "0\r\n\r\nWARC/1.1\r\n\r\n")]
    got = warc.read_archives(warc.write_archives(pages(spark, rows)), keep_payload=True).collect()
    payload = lambda h: (h or "").encode()
    keeper = {}
    for p, _, h in rows:
        keeper[payload(h)] = max(keeper.get(payload(h), -1), -1 if p is None else p)
    want = sorted((str(p), len(payload(h)), warc.sha1(payload(h)), *(("revisit", keeper[payload(h)]) if p is not None and p < keeper[payload(h)] else ("response", None))) for p, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in got) == want
    text = {(p, payload(h)) for p, _, h in rows}
    assert all((r.page_id, bytes(r.body)) in text for r in got if r.type == "response")
    assert any(len(r.body) > 3 * warc.SEGMENT for r in got if r.type == "response")


def test_least_revisit_and_empty(spark):
    got = warc.read_archives(warc.write_archives(pages(spark, [(1, "", "ab"), (2, "", "ab"), (3, "", "long text"), (4, "", "long text")]), least_revisit=5)).collect()
    assert sorted((r.page_id, r.type) for r in got) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    assert warc.read_archives(warc.write_archives(pages(spark, []))).collect() == []


def test_missing_segment_is_an_error(spark):
    made = warc.records_of("<urn:x-page:1#0.0>", 1, "u", b"z" * 100_000, None)
    df = spark.createDataFrame([(0, b"".join(made[:1] + made[2:]))], "archive long, warc binary")
    with pytest.raises(Exception, match="are missing"):
        warc.read_archives(df).collect()


@pytest.mark.parametrize("size", [0, 1, warc.CHUNK, warc.CHUNK + 1])
def test_chunks(size):
    assert warc.from_chunks(warc.to_chunks(b"\r" * size)) == b"\r" * size
    assert warc.from_chunks(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
