import gzip
import hashlib
import io
import random

import pytest
from llm_cases import collected

from trailmarts.llm import warc
from trailmarts.session import fresh_dir


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", None) for i, u, h in rows], "page_id long, url string, html string, digest string, n int").repartition(3)


def plain(rows, least=1000):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        kept = max(same) if same and len(body) >= least else page_id
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "response" if kept == page_id else "revisit", None if kept == page_id else kept))
    return sorted(out, key=repr)


def pages():
    rng = random.Random(5)
    rows = [(0, None, None), (1, "", ""), (2, "http://a.b/ü x\r\ny", "\r\n\r\n" * 400), (3, "u", "é" * 499), (4, "u", "é" * 500), (5, "u", "é" * 500), (6, "u", "z" * 300_000), (-7, "u", "é" * 500)]
    rows += [(100 + i, f"http://h/{i}", "many copies " * 100) for i in range(60)]
    rows += [(200 + i, "u", "".join(rng.choice("ab\n\x00WARC/1.1") for _ in range(rng.randint(0, 3000)))) for i in range(30)]
    return [*rows, (None, "u", "no id " * 300), (None, "u", "no id " * 300), (None, "u", "é" * 500)]


@pytest.mark.parametrize("size", [64 << 20, 2000])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    assert collected(warc.round_trip(frame(spark, pages())).drop("url")) == plain(pages())


def test_repeated_rows_are_all_written(spark):
    rows = [(1, "u", "q" * 2000), (1, "u", "q" * 2000), (0, "u", "q" * 2000)]
    assert collected(warc.round_trip(frame(spark, rows)).drop("url")) == plain(rows)


def test_one_member_per_record_and_no_payload_in_revisits(spark, tmp_path):
    rows = [(1, "http://x/1", "p" * 5000), (2, "http://x/2", "p" * 5000)]
    files = warc.write(frame(spark, rows), str(tmp_path)).collect()
    members = []
    for f in files:
        data = (tmp_path / f.name).read_bytes()
        members += list(warc.members(io.BytesIO(data)))
        assert gzip.decompress(data) == b"".join(warc.members(io.BytesIO(data)))
    assert len(members) == sum(f.n_records for f in files) == 2
    kinds = {warc.parse(m)[0]["warc-type"]: warc.parse(m) for m in members}
    assert b"ppp" in kinds["response"][1] and b"ppp" not in kinds["revisit"][1]
    assert kinds["revisit"][0]["warc-refers-to"] == "<urn:page:2>" and kinds["revisit"][0]["warc-target-uri"] == "http://x/1"


def test_damage_is_noticed():
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(good.replace(b"payload\r\n", b"paylord\r\n"))
    with pytest.raises(ValueError, match="length"):
        warc.parse(good[:-4])
    with pytest.raises(ValueError, match="payload digest"):
        warc.parse(warc.record(1, "u", b"payload", "0" * 40, None))
    with pytest.raises(ValueError, match="within a record"):
        list(warc.members(io.BytesIO(gzip.compress(good)[:-9])))


def test_no_pages(spark):
    assert warc.round_trip(frame(spark, [])).collect() == []
    assert fresh_dir(spark, "x")
