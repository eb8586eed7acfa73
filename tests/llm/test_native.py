"""Exact dedup, decontamination and revisits against DuckDB, and their odd cases."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kinfold.llm import decontamination, exact_dedup, warc_revisit
from kinfold.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(name, same_as_oracle):
    same_as_oracle(name, llm.queries()[name], llm.oracle_sql()[name])


def docs(spark, rows, more=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"h": F.lit("mine"), "n": F.lit(1), "salt": F.lit(2), "keep_id": F.lit(None).cast("string")}) if more else df


ROWS = [(1, "a b\tc"), (2, "abc"), (3, "a  b c "), (4, None), (5, ""), (6, " \n"), (7, "Abc"), (8, "ab c"), (9, "x" * 200_000), (9, "x" * 200_000), (None, "abc")]


def test_exact_dedup_cases(spark):
    got = {(r["doc_id"], r["kept"]): r for r in exact_dedup.classes(docs(spark, ROWS)).collect()}
    assert got[3, True]["group_size"] == 4 and {k[0] for k in got if got[k]["keep_id"] == 3} == {1, 2, 3, None}
    assert got[6, True]["keep_id"] == 6 and {k[0] for k in got if got[k]["keep_id"] == 6} == {4, 5, 6}  # most code points
    assert (9, True) in got and (9, False) in got and got[9, True]["group_size"] == 2
    assert got[3, True]["text_sha256"] == hashlib.sha256(b"abc").hexdigest()
    kept = exact_dedup.dedup(docs(spark, ROWS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 7, 8, 9] and kept.columns == docs(spark, ROWS).columns


def test_hot_text_is_salted_and_merged(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("same"), F.repeat(F.lit(" "), (F.col("id") % 2).cast("int")))).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.classes(rows)
    assert got.where("kept").count() == 1001 and got.where("group_size = 2000").select("keep_id").distinct().collect() == [(1,)]


def test_exact_dedup_empty(spark):
    assert exact_dedup.classes(docs(spark, [])).count() == 0


def brute(documents, items, width=8):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").translate(low))
    out = []
    for d, t in documents:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            q = words(x)
            for g in {tuple(q[k : k + width]) for k in range(max(1, len(q) - width + 1))} if q else ():
                for s in range(len(w) - len(g) + 1):
                    if tuple(w[s : s + len(g)]) == g:
                        hit |= set(range(s, s + len(g)))
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark):
    item = "One two THREE four five six seven eight nine"
    items = [(1, item), (10, item.lower()), (2, "short one"), (3, None), (4, "..."), (5, "É1 x2")]
    documents = [(1, "zero " + item + " ten"), (2, "one two three four five six seven"), (3, "A short, one; short one!"), (4, None), (5, ""), (6, "é1 x2 É1-X2"), (7, ("one two three four five six seven eight nine " * 3) + "short one"), (8, "q " * 5000 + item), (8, "q " * 5000 + item)]
    got = decontamination.report(docs(spark, documents), spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit(1)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(documents, items)
    left = decontamination.clean(docs(spark, documents), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5, 6]


def test_decontamination_near_matches(spark):
    d = docs(spark, [(1, "alpha x beta gamma"), (2, "gamma beta alpha"), (3, "alpha x x x beta gamma")], more=False)
    grams = decontamination.windows_of(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    lists = decontamination.anchored(d, grams)
    index = decontamination.build_index(d, lists, 6)
    assert sorted(r["doc_id"] for r in decontamination.near(index, lists, 1).collect()) == [1, 2]
    assert decontamination.exact(index, lists).count() == 0


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(docs(spark, []), none).count() == 0
    assert [r["n_items"] for r in decontamination.report(docs(spark, [(1, "a b")]), none).collect()] == [0]


def test_revisits(spark):
    rows = [
        (1, "http://www.A.com:80/x?b=2&a=1#f", "2024-01-01 00:00:00", "response", {"ETag": '"1"', "Content-Type": "t", "Vary": "v"}, "d1", 10),
        (2, "https://a.com/x?a=1&b=2", "2024-01-02 00:00:00", "revisit", {"etag": 'W/"1"', "Server": "s", "Date": "later"}, None, None),
        (3, "https://a.com/x?a=1&b=2", "2024-01-03 00:00:00", "revisit", {"etag": '"2"'}, None, None),
        (4, "https://a.com/x?a=1&b=2", "2024-01-01 00:00:00", "revisit", {"etag": '"1"'}, None, None),
        (5, "https://a.com/x?a=1&b=2", "2024-01-04 00:00:00", "revisit", None, None, None),
        (6, None, "2024-01-04 00:00:00", "revisit", None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts string, kind string, headers map<string,string>, digest string, length long").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("span", F.lit("x"))
    got = {r["record_id"]: r for r in warc_revisit.resolve(df).collect()}
    assert {k: v["status"] for k, v in got.items()} == {2: "resolved", 3: "validator_mismatch", 4: "no_earlier_response", 5: "unvalidated", 6: "no_earlier_response"}
    assert got[2]["headers"] == {"etag": 'W/"1"', "content-type": "t", "vary": "v", "date": "later"} and got[2]["response_id"] == 1 and got[2]["canonical_url"] == "a.com/x?a=1&b=2"
    assert warc_revisit.resolve(df.where("false")).count() == 0


def test_hot_text_in_two_spellings_keeps_one_row(spark):
    rows = [(0, "ab c"), (0, "abc"), *((k, "abc") for k in range(1, 2000)), (5, "x"), (5, "x"), (None, "y"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_h": F.lit(7), "_id": F.lit(8), "_n": F.lit(9), "key": F.lit(1), "row": F.lit(2)})
    kept = exact_dedup.classes(df).where("kept").select("doc_id", "keep_id", "group_size").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(0, 0, 2001), (5, 5, 2), (None, None, 2)], key=str)
    got = exact_dedup.dedup(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(0, "ab c", 7, 8, 9, 1, 2), (5, "x", 7, 8, 9, 1, 2), (None, "y", 7, 8, 9, 1, 2)], key=str)


def test_decontamination_beyond_a_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "q r s")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h y"), (2, "q r s t"), (2, "clean one"), (None, "q R s"), (3, None)], "doc_id long, text string").withColumns({"h": F.lit(1), "key": F.lit(2), "t": F.lit(3)})
    want = sorted(map(tuple, decontamination.report(docs, items).collect()), key=str)
    left = sorted((tuple(r)[:2] for r in decontamination.clean(docs, items, min_items=1).collect()), key=str)
    assert left == sorted([(2, "clean one"), (3, None)], key=str)
    monkeypatch.setattr("kinfold.llm._shared.BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontamination.report(docs, items).collect()), key=str) == want


def test_revisits_of_one_url_against_brute_force(spark, monkeypatch):
    """Ties, repeated revisits and stray times; many spans of few records."""
    import random

    monkeypatch.setattr(warc_revisit, "SEGMENTS", 40)
    rnd = random.Random(8)
    times = [0, 5, *(1_700_000_000 + rnd.randrange(200) for _ in range(298))]
    rows = [(k, "http://h.org/" + "p" * 3000 if k % 3 else f"http://h.org/{k % 5}", t, rnd.choice(["response", "revisit"]), {"etag": f'"{rnd.randrange(3)}"'} if k % 4 else None) for k, t in enumerate(times)]
    rows += rows[-5:]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, kind string, headers map<string,string>")
    df = df.withColumns({"ts": F.timestamp_seconds("s"), "digest": F.lit("d"), "length": F.lit(1).cast("long"), "r": F.lit(1), "us": F.lit("x")})
    want = []
    for k, url, t, kind, h in rows:
        if kind == "revisit":
            found = max(((r[2], r[0], r[4]) for r in rows if r[1] == url and r[3] == "response" and r[2] < t), default=None, key=lambda x: x[:2])
            status = "no_earlier_response" if not found else "unvalidated" if not h or not found[2] else "resolved" if h == found[2] else "validator_mismatch"
            want.append((k, status, found[1] if found and status in ("resolved", "unvalidated") else None))
    got = [(r["record_id"], r["status"], r["response_id"]) for r in warc_revisit.resolve(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_files_are_read(spark, tmp_path):
    import gzip

    def record(kind, rid, when, block):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{rid}>\r\nWARC-Target-URI: http://a.org/x\r\nWARC-Date: {when}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    parts = [
        record("warcinfo", "i", "2024-01-01T00:00:00Z", b"software: x"),
        record("response", "a", "2024-01-01T00:00:00Z", b'HTTP/1.1 200 OK\r\nETag: "1"\r\nVary: v\r\n\r\n\r\n\r\nbody\xff'),
        record("revisit", "b", "2024-01-02T00:00:00.5Z", b'HTTP/1.1 304 Not Modified\r\nETag: W/"1"\r\nDate: later\r\n\r\n'),
    ]
    (tmp_path / "one.warc").write_bytes(b"".join(parts[:2]))
    (tmp_path / "two.warc.gz").write_bytes(b"".join(map(gzip.compress, [parts[0], parts[2]])))
    records = warc_revisit.read_warc(spark, tmp_path.as_uri())
    assert {r["record_id"]: (r["kind"], r["length"]) for r in records.collect()} == {"urn:a": ("response", 9), "urn:b": ("revisit", 0)}
    (got,) = warc_revisit.resolve(records).collect()
    assert (got["status"], got["response_id"], got["headers"]) == ("resolved", "urn:a", {"etag": 'W/"1"', "vary": "v", "date": "later"})
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc_revisit.parse_warc(b"junk"))
    with pytest.raises(ValueError, match="cut short"):
        list(warc_revisit.parse_warc(parts[1][:-12]))


def test_matches_of_both_kinds(spark):
    items = spark.createDataFrame([("i", "alpha beta gamma delta"), ("j", "one two")], "item_id string, text string")
    rows = [(1, "x alpha beta gamma delta y"), (2, "alpha new beta gamma more delta"), (3, "delta gamma beta alpha"), (4, "alpha beta"), (5, "one between two"), (None, "ONE two")]
    got = {(r["doc_id"], r["item_id"], r["kind"], r["start"]) for r in decontamination.matches(spark.createDataFrame(rows, "doc_id long, text string"), items, 4, 2).collect()}
    assert {x for x in got if x[2] == "exact"} == {(1, "i", "exact", 1), (None, "j", "exact", 0)}
    assert {x[:2] for x in got if x[2] == "near"} == {(1, "i"), (2, "i"), (3, "i"), (5, "j"), (None, "j")}
