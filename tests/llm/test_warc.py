import base64
import gzip
import hashlib

import pytest

from doctally.llm import warc as W


@pytest.mark.parametrize("key", [0, 1, -1, 2**62, 2**63 - 1, -(2**63), None])
def test_record_ids_hold_keys(key):
    assert W.key_of(W.record_id(key)) == key


@pytest.mark.parametrize("bound", [100_000, 0])
def test_pages(spark, stored, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(W, "BROADCAST_GROUPS", bound)
    rows = [(5, "u", "a"), (3, "u", "a"), (9, None, "a"), (1, "x", None), (2, "x", ""), (7, "é y", "zz"), (7, "y", "zz"), (None, "q", "zz"), (8, "b\r\nc", "long " * 60_000), (-4, "n", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumns({c: pages["url"] for c in ("_id", "_sha", "_first", "_n")})
    found = W.op5_warc(spark, stored(pages=pages)).collect()
    assert len(found) == len(rows)
    first = {}
    for i, _, t in rows:
        first[t or ""] = min(i if i is not None else 1 << 62, first.get(t or "", 1 << 62))
    for r in found:
        raw = (next(t for i, _, t in rows if i == r["page_id"]) or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        want = first[raw.decode()]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == want else ("revisit", want))


def test_archives_are_deterministic_and_whole(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 7} " * 200) for i in range(60)], "page_id long, url string, html string")
    sums = []
    for run in ("a", "b"):
        manifest = W.write_archive(pages.repartition(5), f"{tmp_path}/{run}", file_bytes=1500, shards=3)
        sums.append(sorted(map(tuple, manifest.collect())))
        for name, records, size, sha in sums[-1]:
            data = (tmp_path / run / name).read_bytes()
            assert (len(data), hashlib.sha256(data).hexdigest()) == (size, sha) and gzip.decompress(data).count(b"WARC/1.1") == records
        assert not list((tmp_path / run).glob("_temporary*"))
    assert sums[0] == sums[1] and len(sums[0]) > 3 and sum(x[1] for x in sums[0]) == 60


def test_empty(spark, tmp_path):
    W.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/e")
    assert W.read_archive(spark, f"{tmp_path}/e").count() == 0


def test_damage_is_seen(spark, tmp_path):
    record = W.record(1, "u", b"payload", None, True)
    broken = gzip.compress(gzip.decompress(record).replace(b"payload", b"paYload"))
    with pytest.raises(ValueError, match="digest"):
        list(W.parse(broken))
    with pytest.raises(ValueError, match="ends within"):
        list(W.parse(record[:-5]))


def test_only_the_manifest_counts(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    folder = tmp_path / "a"
    names = [r["file"] for r in W.write_archive(pages, str(folder), file_bytes=1500, shards=3).collect()]
    (folder / "part-00099-00000.warc.gz").write_bytes((folder / names[0]).read_bytes())  # left by a failed attempt
    found = W.read_archive(spark, str(folder))
    assert sorted(r["page_id"] for r in found.collect()) == list(range(40))
    whole = (folder / names[0]).read_bytes()
    for damage in (whole[:-1], whole + whole, W.record(1, "u", b"x", None, True)):
        (folder / names[0]).write_bytes(damage)
        with pytest.raises(Exception, match="is not the archive"):
            W.read_archive(spark, str(folder)).collect()
    (folder / names[0]).unlink()
    with pytest.raises(Exception, match="FileNotFound|No such file"):
        W.read_archive(spark, str(folder)).collect()


def test_parsing_is_linear():
    import time

    one = W.record(1, "http://h/", b"small", None, True)
    took = []
    for n in (2000, 16000):
        began = time.perf_counter()
        assert sum(1 for _ in W.parse(one * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0]


def test_equal_rows_are_dealt_out(spark, tmp_path):
    pages = spark.createDataFrame([(7, "http://h/", "the same page " * 20)] * 400, "page_id long, url string, html string").repartition(4)
    manifest = W.write_archive(pages, f"{tmp_path}/a", shards=4).collect()
    assert sum(r["records"] for r in manifest) == 400 and max(r["records"] for r in manifest) < 300
    assert W.read_archive(spark, f"{tmp_path}/a").where("record_type = 'response' and page_id = 7").count() == 400
