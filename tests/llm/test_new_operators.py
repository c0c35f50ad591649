"""Archives, whitening and the filter audit against plain versions of themselves."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from corpuslens.llm import filter_audit, queries, warc, whitening

SF = "/root/testdata/sf0.001"


# Archives


def _plain_archive(pages):
    """page_id, payload -> the expected row, by hand."""
    newest = {}
    for page, html in pages:
        low = -(1 << 63) if page is None else page
        newest[html or ""] = max(newest.get(html or "", low), low)
    rows = Counter()
    for page, html in pages:
        raw = (html or "").encode()
        low = -(1 << 63) if page is None else page
        target = newest[html or ""] if newest[html or ""] > low else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        rows[(page, len(raw), digest, "response" if target is None else "revisit", target)] += 1
    return rows


PAGES = [
    (5, "http://a.example/x y", "<p>same</p>"), (9, None, "<p>same</p>"), (2, "http://b.example/\r\nX-Bad: 1", "<p>same</p>"),
    (9, None, "<p>same</p>"), (7, "", None), (3, "http://c.example/ü", ""), (None, "http://d.example", "<p>same</p>"),
    (None, None, "alone \r\n\r\n WARC/1.1 \x00"), (4, "http://e.example", "long " * 400_000), (6, "http://f.example", "漢字 <b>"),
]


def _rows(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_archives_read_back_as_written(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("target", F.lit("clash"))
    assert _rows(warc.archive_digest(pages.repartition(3))) == _plain_archive([(p, h) for p, _, h in PAGES])


def test_archives_of_a_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert _rows(queries.QUERIES["op11_warc"](spark, SF)) == _plain_archive([(r.page_id, r.html) for r in pages.collect()])


def test_no_pages(spark):
    assert warc.archive_digest(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_short_payloads_need_not_be_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.archive_digest(pages, least=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def _archive():
    records = [warc.write_record(i, f"http://x.example/{i}", b"<html>%d</html>" % i * 50, None if i % 3 else 99) for i in range(1, 60)]
    return records, warc.encode_archive(records)


def test_archive_layout_and_headers():
    records, raw = _archive()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D
    # Any decoder that is given the dictionary can take one record alone.
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj().decompress(raw[8 + size :])
    assert first == records[0]
    found = list(warc.read_archive(raw))
    assert [r.headers["x-page-id"] for r in found] == [str(i) for i in range(1, 60)]
    assert found[0].headers["warc-record-id"] == warc.record_id(1, found[0].headers["warc-payload-digest"].removeprefix("sha1:"))


def test_a_dictionary_that_is_compressed_itself():
    records, raw = _archive()
    _, size = struct.unpack_from("<II", raw)
    packed = zstandard.ZstdCompressor().compress(raw[8 : 8 + size])
    other = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + raw[8 + size :]
    assert len(list(warc.read_archive(other))) == len(records)


@pytest.mark.parametrize("harm", [
    lambda raw: raw[:-3],
    lambda raw: raw[8 + struct.unpack_from("<II", raw)[1] :],  # no dictionary
    lambda raw: raw + b"junk.junk",
    lambda raw: raw + raw,  # a dictionary in the middle
    lambda raw: raw[:-40] + bytes([raw[-40] ^ 255]) + raw[-39:],
])
def test_broken_archives_are_refused(harm):
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(harm(_archive()[1])))


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date: ", b"Other: "), (b"Content-Length: 1", b"Content-Length: -1"),
    (b"<html>", b"<HTML>"), (b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"), (b"\r\n\r\n", b"\n\n"),
    (b"WARC-Type: response", b"WARC-Type: metadata"), (b"200 OK\r\n", b"200 OK\r\nbroken\r\n"),
])
def test_broken_records_are_refused(old, new):
    raw = warc.write_record(1, "http://x.example", b"<html>abc</html>" * 9, None)
    with pytest.raises(warc.ArchiveError):
        warc.parse_payload(warc.parse_record(raw.replace(old, new)))


# Whitening


def _plain_whitening(vectors, count=8):
    """id -> (deviation, whitened), and explained, from all vectors at once."""
    kept = [(i, v) for i, v in vectors if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    sizes = Counter(len(v) for _, v in kept)
    size = max(sizes, key=lambda s: (sizes[s], s))
    kept = [(i, v) for i, v in kept if len(v) == size]
    x = np.array([[int(np.floor(1024.0 * c)) + 100_000 for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    y = (n * x - sums).astype(np.float64) / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:count], basis[:, ::-1][:, :count]
    return [i for i, _ in kept], deviation, y @ basis / np.sqrt(values), values / (y.T @ y / n).trace()


def _compare_whitening(df, vectors, tolerance=1e-7):
    ids, deviation, white, share = _plain_whitening(vectors)
    got = df.toPandas()
    assert len(got) == len(ids) * white.shape[1]
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((wide * white).sum(0))
    assert np.abs(wide * sign - white).max() < tolerance * np.abs(white).max()
    first = got[got.component == 1].set_index("vec_id").loc[ids]
    assert first["deviation"].tolist() == [int(v) for v in deviation] and set(got["n"]) == {len(ids)}
    for k, s in enumerate(share, 1):
        assert np.allclose(got[got.component == k]["explained"], s, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    _compare_whitening(queries.QUERIES["op12_whitening"](spark, SF), [(r.vec_id, r.embedding) for r in rows])


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.25] + 7
    x[50:200] = x[7]  # half the table is one vector
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    vectors += [(900, None), (901, []), (902, [1.0] * 5), (903, [float("nan")] + [0.0] * 5), (904, [float("inf")] + [0.0] * 5), (905, [None] + [0.0] * 5)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("x", F.lit(1))
    vectors = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in vectors]
    _compare_whitening(whitening.whitened(df.repartition(40)), vectors)


def test_whitening_without_variance(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).toPandas()
    assert len(same) == 4 and same["whitened"].isna().all() and same["identity_error"].isna().all() and (same["deviation"] == 0).all()
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], kind)).toPandas()
    assert line[line.component == 2]["whitened"].isna().all() and (line[line.component == 2]["explained"] == 0).all()
    assert line["identity_error"].max() < 1e-9


def test_whitening_of_enormous_entries(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], "vec_id bigint, embedding array<float>")
    got = whitening.whitened(df).toPandas()
    assert len(got) == 6 and (got[got.vec_id == 1]["deviation"] == (1 << 63) - 1).all()


@pytest.mark.parametrize("seed", range(8))
def test_rank_one_updates_keep_the_spectrum(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 20))
    values = np.sort(rng.integers(0, 4, n).astype(float) * 10.0 ** rng.integers(-6, 6))  # with equal values and zeros
    basis = np.linalg.qr(rng.normal(size=(n, n)))[0]
    x = rng.normal(size=n) * (rng.random(n) < 0.5)
    whole = basis @ np.diag(values) @ basis.T + 2.5 * np.outer(x, x)
    got_values, got_basis = whitening.rank_one_update(values, basis, x, 2.5)
    size = max(1.0, np.abs(whole).max())
    assert np.abs(got_values - np.linalg.eigvalsh(whole)).max() < 1e-12 * size
    assert np.abs(got_basis.T @ got_basis - np.eye(n)).max() < 1e-12
    assert np.abs(got_basis @ np.diag(got_values) @ got_basis.T - whole).max() < 1e-12 * size


@pytest.mark.parametrize("cuts", [[], [1, 2, 3], [40], [3, 50, 51, 90]])
def test_merged_spectra_are_those_of_all_vectors(cuts):
    x = np.random.default_rng(5).normal(size=(100, 7)) * np.arange(1, 8) + 50
    x[20:60] = x[20]
    whole = whitening.Spectrum.empty(7)
    for part in np.split(x, cuts):
        mine = whitening.Spectrum.empty(7)
        for row in part:
            mine.add(row)
        whole.merge(whitening.Spectrum.from_bytes(mine.to_bytes(), 7))
    y = x - x.mean(0)
    assert whole.n == 100 and np.allclose(whole.mean, x.mean(0))
    assert np.abs(whole.basis @ np.diag(whole.values) @ whole.basis.T - y.T @ y).max() < 1e-9


# Filter audit


def _plain_audit(docs, labels):
    good, toxic = ({i for i, *m in labels if m[k] == 1} for k in (0, 1))
    fails = []
    for doc, text, source in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        own = float("inf") if doc is None else doc
        fails.append((source or "", doc, "".join(c for c, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            any(c in "#$%&*|" for c in text), any((float("inf") if d is None else d) < own and (t or "") == text for d, t, _ in docs),
        ), strict=True) if bad)))
    rows = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                earlier = set(order[: step - 1])
                alive = [f for f in mine if not earlier & set(f[2])]
                gone = [f for f in alive if c in f[2]]
                failing = [f for f in mine if c in f[2]]
                rows[part, "".join(order), step] = [
                    len(alive) - len(gone), len(gone), len(failing) - len(gone), sum(f[2] == c for f in failing),
                    sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone), 0,
                ]
    for (part, order, step), row in rows.items():
        c = order[step - 1]
        row[6] = sum(rows[p, o, s][1] for p, o, s in rows if p == part and o[s - 1] == c)
    return {k: tuple(v) for k, v in rows.items()}


def _audit_rows(df):
    assert df.columns[:3] == ["part", "filter_order", "step"]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}
    assert len(got) == df.count()
    return got


def test_audit_against_all_orders_by_hand(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "a"), (2, long, "a"), (3, long, None), (4, long + " $", "a"), (5, "X " * 300, "b"), (6, None, "b"), (7, "", None), (None, long, "a"),
        (2, long, "a"), (2, "other #", "b"), (8, "word " * 199, "c"), (9, "word " * 40_000, "c"), (10, long.upper(), "a"), (11, "Ünïc 漢字 " * 120, ""),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (5, None, 1), (None, 1, 1), (6, 1, None), (77, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("mask", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = _audit_rows(filter_audit.audit(df.repartition(5), marks))
    known = [(i, *[max([r[k] or 0 for r in labels if r[0] == i]) for k in (1, 2)]) for i in {r[0] for r in labels} - {None}]
    assert got == _plain_audit(docs, known)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 1000, 4097])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    plain = [int(((words >> np.uint32(b)) & np.uint32(1)).sum()) for b in range(32)]
    assert filter_audit.positional_popcount(words).tolist() == plain


def test_more_parts_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 3)
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(40), "text": ["a b"] * 40, "source": [f"s{i % 8}" for i in range(40)]}))
    got = filter_audit.audit(docs.repartition(4), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert got.filter("filter_order = 'ABCDE' and step = 1").agg(F.sum("removed")).first()[0] == 40
