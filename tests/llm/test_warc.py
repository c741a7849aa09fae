import base64
import hashlib
import io

import zstandard
from pyarrow import BufferReader

from sieveline.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string"


def want(rows, least=0):
    out = []
    for k, _, html, _ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None]
        again = len(data) >= least and same and k != min(same)
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big = "é<p>" * 500_000
    rows = [(5, "http://a/\r\nX: y", "one", "c"), (3, None, "one", "c"), (3, "http://b", "one", "c"), (None, "u", "one", "c"), (1, "u", None, "c"),
            (2, "u", "", "c"), (7, "u", "a\r\n\r\nb", "c"), (8, "u", big, "c"), (9, "u", big, "c"), (None, "u", "alone", "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least in (0, 1, 10**9):
        got = sorted((tuple(r) for r in W.archive(df, str(tmp_path / str(least)), least_bytes=least).collect()), key=str)
        assert got == want(rows, least)
    assert W.archive(df.limit(0)).collect() == []


def test_payloads_come_back_and_frames_stand_alone(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"text {i} " * 50, None) for i in range(200)]
    folder = str(tmp_path / "w")
    index = W.write_bundles(W.plan_records(spark.createDataFrame(rows, SCHEMA).coalesce(1)), folder, frame_bytes=4000, bundle_bytes=3000)
    assert index.select("file").distinct().count() > 1 and index.select("file", "frame").distinct().count() > 10
    back = {int(r.id): bytes(r.payload).decode() for r in W.read_records(index, folder).collect()}
    assert back == {r[0]: r[2] for r in rows}
    # A plain decompressor reads a whole bundle, seek table and all.
    name = sorted(p.name for p in (tmp_path / "w").iterdir())[0]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "w" / name).read_bytes()), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == index.where(index.file == name).count()


def test_seek_table():
    out = io.BytesIO()
    out.close, raw = lambda: None, [b"a" * 10, b"b" * 3000, b"", b"c" * 5]
    w = W.BundleWriter(out, frame_bytes=1000)
    places = [w.add(x) for x in raw]
    w.close()
    r = W.BundleReader(BufferReader(out.getvalue()))
    assert [r.read(*p) for p in reversed(places)] == raw[::-1]
