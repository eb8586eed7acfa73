"""Tokenising, packing, coding, n-gram joins, extraction and the learned operators on small inputs."""

from __future__ import annotations

import random
import re
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import bytewords, language_id, ngram_join, packing, quality, site_style_tree, token_output, toxicity
from kinfold.llm.bpe import byte_bpe

CASES = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 3000), (4, "word " * 3000), (None, "tail"), (5, "中文 café <|endoftext|> don't"), (6, "...")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("mine"), "length": F.lit("x"), "n": F.lit(0), "comp": F.lit("y")})


DATA = Path("/root/testdata")
#: A tokenizer of its own, which nothing in the package has touched.
FRESH = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return FRESH.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library():
    rnd = random.Random(3)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "'s", "'", "ll", "'re", "!", "é", "ß", "×", "–", "€", "1", "22", "²", " ", "中", "\U0001f642", "\r", "|", "x'd", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(3000)] + [None, ""]
    b = byte_bpe()
    for at, buf, offs in bytewords.texts(pa.array(texts), 5000):
        ids, first = b.encode(buf, offs)
        for k in range(len(offs) - 1):
            assert ids[first[k] : first[k + 1]].tolist() == ids_of(texts[at + k])


def test_special_tokens_are_taken_out_of_texts():
    assert ids_of("a<|endoftext|>b") == [64, 50256, 65]


def test_packing_places_every_piece(spark):
    got = packing.pack(docs(spark, CASES)).collect()
    want = []
    for d, t in CASES:
        ids = [*ids_of(t), 0]
        want += [(d, i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(docs(spark, [])).count() == 0


def test_fullest_combination_is_fullest():
    rnd = random.Random(5)
    for _ in range(200):
        items = [rnd.randint(1, 12) for _ in range(rnd.randint(0, 8))]
        room = rnd.randint(0, 30)
        counts = {n: items.count(n) for n in items}
        best = max((sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room), default=0)
        taken = packing.fullest(counts, room)
        assert sum(n * k for n, k in taken.items()) == best and all(counts[n] >= k for n, k in taken.items())


def coded(spark, ids, lens, block=1 << 14, names=None):
    """(payload, the shard's bytes)."""
    token_output.functions(spark)
    names = pa.array([str(k) for k in range(len(lens))] if names is None else names, pa.string())
    raw = token_output.payload(3, 4, 5, names, np.array(lens, np.int64), np.asarray(ids, np.uint32))
    return raw, bytes(spark.createDataFrame([(raw,)], "p binary").select(F.call_function("kinfold_code_shard", "p", F.lit(block))).first()[0])


def decoded(spark, raw):
    return bytes(spark.createDataFrame([(raw,)], "p binary").select(F.call_function("kinfold_read_shard", "p")).first()[0])


def test_range_coder_round_trip(spark):
    rnd = np.random.default_rng(1)
    cases = [rnd.integers(0, 50257, 3000), np.full(3000, 7), np.zeros(0), np.array([(1 << 24) - 1, 0]), rnd.integers(0, 3, 5000), np.cumsum(rnd.integers(0, 3, 5000)) % 700]
    for ids in cases:
        for block in (1, 100, 1 << 14):
            if block > 1 or len(ids) < 10:
                raw, file = coded(spark, ids, [len(ids)], block)
                assert decoded(spark, file) == raw
    assert len(coded(spark, np.full(3000, 7), [3000])[1]) < 200


def test_names_and_lengths_come_back(spark):
    raw, file = coded(spark, range(9), [4, 0, 5, 0], names=["é", None, "", "long " * 100])
    part, start, names, lens, ids = token_output.parsed(decoded(spark, file))
    assert (part, start, names.to_pylist(), lens.tolist(), ids.tolist()) == (3, 5, ["é", None, "", "long " * 100], [4, 0, 5, 0], list(range(9)))


def test_blocks_beat_zlib(spark):
    """On the same blocks, by a fifth at least on the test data's documents."""
    from kinfold.llm._shared import table

    texts = [r["text"] for r in table(spark, str(DATA / "sf0.001"), "documents").orderBy("doc_id").collect()]
    ids = np.array([x for t in texts for x in (*ids_of(t), 2)], np.uint32)
    blocks = [ids[k : k + token_output.BLOCK] for k in range(0, len(ids), token_output.BLOCK)]
    mine = sum(len(coded(spark, b, [len(b)])[1]) for b in blocks)
    assert mine < 0.85 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)


def test_shards_detect_damage(spark):
    _, raw = coded(spark, np.arange(9000), [4000, 0, 5000])
    for k in (0, len(raw) // 2, len(raw) - 1):
        with pytest.raises(Exception, match="checksum"):
            decoded(spark, raw[:k] + bytes([raw[k] ^ 1]) + raw[k + 1 :])


def test_token_output(spark, tmp_path):
    path = (tmp_path / "out").as_uri()
    listed = token_output.write(docs(spark, CASES), path, shard_ids=1)
    files = sorted((tmp_path / "out").glob("*.ktok"))
    assert [p.stat().st_size for p in files] == [r["n_bytes"] for r in listed.orderBy("part", "seq").collect()] and files[0].read_bytes()[:4] == b"KTOK"
    got = token_output.read(spark, path, with_ids=True).collect()
    start = 0
    want = []
    for d, t in sorted(CASES, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*ids_of(t), 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError, match="holds shards"):
        token_output.write(docs(spark, CASES), path)
    assert token_output.round_trip(docs(spark, [])).count() == 0


def test_listing_of_shards_stays_in_the_jvm(spark, tmp_path, capsys):
    path = (tmp_path / "out").as_uri()
    token_output.write(docs(spark, CASES), path, shard_ids=64)
    plain, full = token_output.read(spark, path), token_output.read(spark, path, with_ids=True)
    plain.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    assert plain.schema == full.drop("ids").schema
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, full.drop("ids").collect()), key=str)


def test_coder_writes_the_same_bytes_as_ever(spark):
    """Checksums of what the format's first coder of version 2 wrote."""
    rnd = np.random.default_rng(5)
    zipf = (50257 ** rnd.random(40000)).astype(np.int64)
    zipf[1::3] = zipf[0::3][: len(zipf[1::3])] // 2
    for ids, crc in ((zipf, 0xA74926E1), (rnd.integers(0, 5, 40000), 0x256E13F0), (rnd.integers(0, 1 << 20, 3000), 0xB206E967), (np.r_[zipf[:20], (1 << 24) - 1, 0], 0x0D9AEBD5)):
        raw, file = coded(spark, ids, [len(ids)])
        assert zlib.crc32(file[:-4]) == crc and decoded(spark, file) == raw


def test_pieces_are_told_apart_by_the_bytes_of_their_ids():
    """Words that a worker has not met go to the library together; their ids come back without offsets or words."""
    from kinfold.llm.bpe import ByteBPE
    import public_tokenizers

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeéüßqz") for _ in range(rnd.randint(1, 12))) for _ in range(3 * ByteBPE.TOGETHER)]
    data = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
    bpe, calls = ByteBPE(public_tokenizers.path("byte_bpe_50k.json")), []
    library = bpe.tokenizer

    class Counted:
        def encode_batch_fast(self, strings, **how):
            calls.append(len(strings))
            return library.encode_batch_fast(strings, **how)

    bpe.tokenizer = Counted()
    ids, first = bpe.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == library.encode(" " + " ".join(words), add_special_tokens=False).ids and first.tolist() == [0, len(ids)]
    assert sum(calls) < 20


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(11)
    base = [[f"w{rnd.randrange(500)}" for _ in range(80)] for _ in range(6)]
    rows = []
    for k in range(60):
        w = list(base[rnd.randrange(6)])
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(80)] = f"n{rnd.randrange(10_000)}"
        rows.append((k, " ".join(w)))
    rows += [(60, None), (61, ""), (62, "..."), (63, "a b c"), (64, "A b, c"), (65, "a b"), (66, rows[0][1]), (0, rows[0][1])]
    sets = {}
    for d, t in rows:
        w = tuple((t or "").lower().replace(",", "").split()) if t not in ("...",) else ()
        sets.setdefault(w, []).append(d)
    first = {w: min(x) for w, x in sets.items() if w}
    grams = {first[w]: frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) for w in first}
    link = {(a, b) for a, b in combinations(sorted(grams), 2) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    group = {a: a for a in grams}
    for _ in range(len(group)):
        for a, b in link:
            group[a] = group[b] = min(group[a], group[b])
    want = {}
    for w, ds in sets.items():
        for d in ds:
            want[d] = (group[first[w]], sum(first[w] in p for p in link), first[w]) if w else (d, 0, d)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_id"]) for r in ngram_join.near_duplicates(docs(spark, rows)).collect()}
    assert got == want and max(n for _, n, _ in want.values()) > 2
    left = ngram_join.dedup(docs(spark, rows))
    assert {r["doc_id"] for r in left.collect()} == {d for d, x in want.items() if x[0] == d} and left.columns == docs(spark, rows).columns
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def test_tiles_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 8)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words, f"n{k}"])) for k in range(40)]
    got = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 39)}


def test_banding_reaches_its_recall():
    for s in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.banding(s, 0.999)
        assert 1 - (1 - s**rows) ** bands >= 0.999 > 1 - (1 - s**rows) ** (bands - 1)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=/>menu</a></nav><div class="ad">buy</div>
<article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>  text<br>more<p>Two &lt;x&gt;<div class="comments"><p>reader</p></div><aside>side</aside><form>name</form><footer>foot</footer></article><footer>&copy;</footer>"""


def test_main_text_cases():
    f = site_style_tree.main_text
    assert f(PAGE) == "Head & line One bold text more Two <x>"
    assert f(None) == f("") == f("<p></p>") == ""
    assert f("just  text &eacute;") == "just text é" and f("a < b <p>c") == "a < b c"
    assert f("<div><p>keep</p></div><div id=footer>no</div><ul class='nav'><li>no</ul>") == "keep"
    assert f("<ul><li>a<li>b<ol><li>c</ol></ul><table><tr><td>1<td>2</table>") == "a b c 1 2"
    assert f("<b>" * 5000 + "deep") == "deep" and site_style_tree.observations("<div>" * 5000) == {}


def test_low_branches_of_a_site_go(spark):
    page = lambda k: f"<body><div class=top><p>the same on each</p></div><div class=body><p>text number {k}</p></div></body>"
    rows = [(k, f"http://www.x.com/{k}", page(k)) for k in range(20)] + [(20, None, None), (21, "http://y.com/", page(21)), (0, "http://www.x.com/0", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "low": F.lit(2), "text": F.lit(3)})
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in site_style_tree.extract(df).collect()}
    assert got[7] == ("text number 7", 13) and got[20] == ("", 0) and got[21][0] == "the same on each text number 21" and len(got) == 22
    assert site_style_tree.extract(df.where("false")).count() == 0


def site(spark, pages, host="x.com"):
    return spark.createDataFrame([(k, f"http://{host}/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")


def test_branches_of_equal_tags_are_told_apart(spark):
    """By id, by place, and by place below nodes whose ids only differ in a number."""
    pages = [f"<body><div id=top>same on each page</div><div id=text>new text {k}</div><div id=p{k}><div>same again</div><div>more {k}</div></div></body>" for k in range(12)]
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(site(spark, pages)).collect()}
    assert got == {k: f"new text {k} more {k}" for k in range(12)}


def test_low_branches_inside_an_article_go(spark):
    """Blocks of every kind; but no inline element beside text, though it is the same on each page."""
    pages = [f"<article><h2>Our paper</h2><figure>logo</figure><div><span>by</span><span>writer {k}</span></div><p><span>LONDON</span> news {k}<p>Read more here<address>street</address></article>" for k in range(12)]
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(site(spark, pages)).collect()}
    assert got == {k: f"writer {k} LONDON news {k}" for k in range(12)}


def test_hosts_of_any_size_and_pages_of_any_depth(spark):
    page = lambda k: f"<body><div class=top>the same on each</div><div class=body>text number {k}</div></body>"
    deep = lambda k: "<body>" + "<div>" * 3000 + f"<p>all alike<p>text number {k}"
    story = "<article><p>one story<p>told on</article>"
    for of in (page, deep):
        for n in (2, 3, 7):
            got = {r["page_id"]: r["text"] for r in site_style_tree.extract(site(spark, [of(k) for k in range(n)])).collect()}
            assert got == {k: f"text number {k}" for k in range(n)}
    # copies of one page, and pages that share most of a long text, are no evidence against it
    tail = "".join(f"<p>part {j}" for j in range(9))
    rows = [story] * 20 + [f"<article><p>other {k}" for k in range(3)] + [f"<article><p>begin {k}{tail}" for k in range(2)]
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(site(spark, rows)).collect()}
    assert got[0] == got[19] == "one story told on" and got[20] == "other 0" and got[23].endswith("part 7 part 8") and got[23].startswith("begin 0 part 0")


def test_an_article_in_marked_branches_is_found(spark):
    f, story = site_style_tree.main_text, "<article><h1 class=header>Head</h1><p>text</article>"
    for before, after in (("<form>", "</form>"), ("<body class='search'>", ""), ("<div id='modal'>", "</div>"), ("<div class='sidebarlayout'>", "</div>"), ("<main><form>", "</form></main>"), ("<div hidden>", "</div>")):
        assert f(f"{before}{story}{after}") == f(f"<div>menu</div>{before}{story.replace('article', 'main')}{after}") == "Head text"
    assert f("<article><div id=header><h1>Head</h1></div><div class=header>log in</div><p>text</article>") == "Head text"
    assert f(f"<div class=comments>{story}</div><p>own") == f("<p>own<article class=comment>reader</article>") == f(f"<aside>{story}</aside><p>own") == "own"
    # names that stand against most of the text of many pages, and such that don't
    pages = [f"<div class=widget><form><p>a longer text number {k}</form></div><div class=ad>{k}</div>" for k in range(20)]
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(site(spark, pages)).collect()}
    assert got == {k: f"a longer text number {k}" for k in range(20)}


def test_weak_labels_find_the_labellers():
    rnd = random.Random(2)
    n, counts, truth = len(quality.LABELLERS), {}, {}
    for _ in range(4000):
        bad = rnd.random() < 0.2
        code = sum((2 if rnd.random() < ((0.6 if bad else 0.02)) else 1) * 3**j for j in range(n - 1))
        counts[code] = counts.get(code, 0) + 1
        truth.setdefault(code, []).append(bad)
    post, says = quality.weak_labels(counts)
    right = sum(sum((post[c] > 0.5) == b for b in bs) for c, bs in truth.items())
    assert right > 3900 and all(abs(says[0][: n - 1] - 0.6) < 0.06)


def test_quality_keeps_prose_and_rejects_junk(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    prose = [(k, ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(8)) + ".") for k in range(300)]
    junk = [(1000 + k, " ".join(word() + rnd.choice(["###", "%%%", "***"]) for _ in range(60))) for k in range(40)] + [(2000 + k, " ".join(word().upper() + "!!" for _ in range(60))) for k in range(40)]
    rows = prose + junk + [(3000, None), (3001, ""), (3002, "short")]
    got = {r["doc_id"]: r["rejected"] for r in quality.assess(docs(spark, rows)).collect()}
    assert not any(got[d] for d, _ in prose) and all(got[d] for d, _ in junk) and got[3000] and got[3001] and not got[3002]
    left = quality.keep(docs(spark, rows))
    assert left.count() == 301 and left.columns == docs(spark, rows).columns
    assert quality.assess(docs(spark, [])).count() == 0


def toxicity_rows(texts, y, identity):
    table, pattern = bytewords.word_table(), toxicity.swapper(identity)
    own = [toxicity.slots_of(t, table) for t in texts]
    copies = [[toxicity.slots_of(c, table) for c in toxicity.counterfactuals(t, identity, pattern)] for t in texts]
    known = np.unique(np.concatenate(own))
    of = lambda a, b: np.searchsorted(known, x[np.isin(x, known)]) if len(x := np.setdiff1d(a, b)) else x
    rows = toxicity.Rows(y, [np.searchsorted(known, x) for x in own], [[(of(c, x), of(x, c)) for c in cs] for x, cs in zip(own, copies)])
    return rows, known


GROUPS = (("people", "muslims", "jews", "gays"),)


def biased_texts():
    """Toxic texts, of which most mention one group and most have an insult; clean ones seldom mention that group."""
    rnd = random.Random(0)
    texts, y = [], []
    for _ in range(1500):
        toxic = rnd.random() < 0.3
        group = "muslims" if rnd.random() < (0.9 if toxic else 0.05) else rnd.choice(["people", "jews", "gays"])
        filler = " ".join(f"w{rnd.randrange(60)}x" for _ in range(6))
        texts.append(f"{filler} {group}" + (" moron" if toxic and rnd.random() < 0.7 else ""))
        y.append(float(toxic))
    return texts, y


def test_counterfactual_copies_swap_every_term():
    identity = (("women", "men"), ("jews",))
    pattern = toxicity.swapper(identity)
    assert toxicity.counterfactuals("Women, men and JEWS; womenfolk", identity, pattern, 2) == ["men, women and jews; womenfolk"] * 2
    assert toxicity.counterfactuals("nobody", identity, pattern) == [] and toxicity.counterfactuals("women", (), toxicity.swapper(())) == []


def test_counterfactual_penalty_lowers_false_positives_on_neutral_mentions():
    texts, y = biased_texts()
    rows, known = toxicity_rows(texts, y, GROUPS)
    score = {}
    for c in (0.0, 5.0):
        w, bias = toxicity.fit(rows, len(known), c)
        weights = dict(zip(known.tolist(), w.tolist()))
        logit = lambda t: bias + sum(weights.get(x, 0.0) for x in toxicity.slots_of(t, bytewords.word_table()).tolist())  # noqa: B023, E731
        score[c] = {g: [logit(f"w{k}x w{k + 1}x {g} w{k + 2}x") for k in range(50)] for g in GROUPS[0]} | {"toxic": [logit(f"{g} moron") for g in GROUPS[0]], "w": w}
    false = {c: sum(v >= 0 for v in score[c]["muslims"]) for c in score}
    spread = {c: max(abs(np.mean(score[c][a]) - np.mean(score[c][b])) for a, b in combinations(GROUPS[0], 2)) for c in score}
    assert false[0.0] >= 25 and false[5.0] == 0 and spread[5.0] < 0.2 * spread[0.0] and min(score[5.0]["toxic"]) > 0
    # a ridge shrinks the insult's weights too, and leaves the groups apart beside them
    ridge, _ = toxicity.fit(rows, len(known), 0.0, l2=50.0)
    insult, one, two = (np.searchsorted(known, toxicity.slots_of(x, bytewords.word_table())) for x in ("moron", "muslims", "jews"))
    apart = lambda w: abs(w[one].sum() - w[two].sum()) / w[insult].sum()
    assert apart(score[5.0]["w"]) < 0.1 < 0.3 < apart(ridge)


def test_toxicity_odd_tables(spark):
    rows = [(k % 150, f"plain text number w{k % 37} here muslims" + (" moron" if k % 3 == 0 else "")) for k in range(300)] + [(900, "moron " * 50_000)]
    df = docs(spark, rows).withColumns({"_y": F.lit(1), "y": F.lit(1), "id": F.lit(5), "toxic": F.lit("t"), "slots": F.lit(0)})
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)] * 2, "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.train(df, labels, F.lit(True))
    got = toxicity.score(df, model, F.lit(False)).collect()
    assert len(got) == 301 and {(r["doc_id"], r["predicted"]) for r in got} == {(k, int(k % 3 == 0)) for k in range(150)} | {(900, 1)}
    assert toxicity.score(df.where("false"), toxicity.train(df.where("false"), labels, F.lit(True)), F.lit(False)).count() == 0


def test_toxicity(spark):
    rows = [(k, f"plain text number w{k % 37} here" + (" moron" if k % 4 == 0 else "")) for k in range(400)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(901, None), (None, 1)], "doc_id long, toxic int")
    df = docs(spark, rows)
    fold = language_id.remainder(F.col("doc_id"), 5)
    got = {r["doc_id"]: r for r in toxicity.score(df, toxicity.train(df, labels, fold != 0), fold == 0).collect()}
    assert all(got[k]["predicted"] == (k % 4 == 0) for k in range(400)) and got[900]["score"] == got[901]["score"] < 0.5
    assert got[3]["held_out"] == (zlib.crc32(b"3") % 5 == 0)
    none = toxicity.score(df, toxicity.train(df, labels.where("false"), fold != 0), fold == 0)
    assert none.where("predicted = 1").count() == 0 and none.count() == 402


def test_toxicity_by_beginnings(spark):
    """Insults that share their beginning and nothing else, in small letters and capitals."""
    tail = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    rows = [(k, f"plain text here {'RÉEUXA' if k % 8 == 0 else 'réeuxa'}{tail(k)}" if k % 4 == 0 else f"plain text here {tail(k)}") for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)], "doc_id long, toxic int")
    df, fold = docs(spark, rows), language_id.remainder(F.col("doc_id"), 5)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, toxicity.train(df, labels, fold != 0), fold == 0).collect()}
    assert all(got[k] == (k % 4 == 0) for k in range(600))


def test_forward_sums_all_segmentations():
    pieces = [b"\x01", b"a", b"b", b"ab", b"\x01a", b"ba"]
    lattice = language_id.Lattice(pieces)
    p = np.array([0.1, 0.2, 0.3, 0.15, 0.05, 0.2])

    def total(s):
        return 1.0 if not s else sum(q * total(s[len(x) :]) for x, q in zip(pieces, p) if s.startswith(x))

    words = [b"a", b"ab", b"aba", b"bbab"]
    grid, size = language_id.grid_of(words)
    got, _ = lattice.forward(lattice.edges(grid, size), size, np.log(p)[None, :])
    want = np.log([total(b"\x01" + w) for w in words])
    assert np.allclose(got[:, 0], want)
    logp, edges = np.log(np.stack([p, p[::-1]])), lattice.edges(grid, size)
    assert np.allclose(lattice.log_sums(edges, size, logp)[size, np.arange(4), 0], want)
    assert np.allclose([lattice.long_forward(*lattice.long_edges(w), logp)[-1, 0] for w in words], want)
    weight = np.array([[1.0, 2.0], [0.5, 1.0], [3.0, 0.0], [1.0, 1.0]])
    counts = lattice.expected(edges, size, logp, weight)
    assert np.allclose(lattice.log_expected(edges, size, logp, weight), counts)
    assert np.allclose(sum(lattice.long_expected(w, logp, x) for w, x in zip(words, weight)), counts)


def test_words_are_whole_and_of_letters_only():
    text = "donaudampfschifffahrtsgesellschaft достопримечательность «a–b»🙂c 12\u0301 e\u0301 \u4e2d\u6587"
    buf = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = language_id.cut_words(buf, np.array([0, len(buf)]))
    found = [buf[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert found == ["donaudampfschifffahrtsgesellschaft", "достопримечательность", "a", "b", "c", "e\u0301", "\u4e2d\u6587"]
    pieces = language_id.vocabulary()
    assert max(map(len, pieces)) > 16 and len(language_id.Lattice(pieces).keys) == len(set(pieces))


def test_long_words_of_every_tier_are_learned_and_scored(spark):
    rnd = random.Random(2)
    word = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    rows = [(k, word("abcd" if k % 2 else "wxyz", n), "x" if k % 2 else "y") for k, n in enumerate([5, 70, 600, 40, 300, 2000] * 10)]
    rows += [(900, word("abcd", 3000), None), (901, word("wxyz", 100), None), (902, "Привет", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, F.lit(True), F.lit(False)).collect()}
    assert (got[900], got[901]) == ("x", "y") and all(got[k] == ("x" if k % 2 else "y") for k in range(60)) and got[902] != "und"


def test_repeated_rows_and_other_scripts(spark):
    ru, el = "дом стоит на холме и река течёт мимо него", "το σπίτι είναι στο λόφο και το ποτάμι περνά"
    rows = [(k % 15, ru if k % 2 else el, "ru" if k % 2 else "el") for k in range(60)] + [(70, "мимо дом", None), (71, "—…«»", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"text_": F.lit(1), "score": F.lit("a"), "word": F.lit(2)})
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(df, F.lit(True), F.lit(False)).collect()]
    assert len(got) == 62 and ((70, "ru") in got) and ((71, "und") in got)


def test_language_id(spark):
    en, de = "the house is on the hill and the river runs past it", "das haus steht auf dem berg und der fluss läuft daran vorbei"
    rows = [(k, (en if k % 2 else de) + f" {k}", "en" if k % 2 else "de") for k in range(60)] + [(100, None, "en"), (101, "12 !", "en"), (102, "the river and the hill", None), (103, "X" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    fold = language_id.remainder(F.col("doc_id"), 4)
    got = {r["doc_id"]: r for r in language_id.identify(df, fold != 2, fold == 2).collect()}
    assert all(got[k]["lang_pred"] == ("en" if k % 2 else "de") for k in range(60)) and got[102]["lang_pred"] == "en"
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[100]["score"] == 0 and got[103]["lang_pred"] in ("en", "de")
    assert {r["lang_pred"] for r in language_id.identify(df, F.lit(False), fold == 2).collect()} == {"und"}
    assert language_id.identify(df.where("false"), fold != 2, fold == 2).count() == 0


def test_language_id_learns_from_whole_texts(spark):
    """A language whose few documents are long and open with text in another one."""
    en, de, fr = "the house is on the hill and the river runs past it ", "das haus steht auf dem berg und der fluss daran vorbei ", "la maison est sur la colline et une petite rivière passe devant elle "
    rows = [(k, (en if k % 2 else de) * 3, "en" if k % 2 else "de") for k in range(40)] + [(100 + k, de * 400 + fr * 900, "fr") for k in range(3)] + [(200, fr, None), (201, en, None), (202, de, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, F.lit(True), F.lit(False)).collect()}
    assert (got[200], got[201], got[202], got[100]) == ("fr", "en", "de", "fr")


def test_texts_under_one_id_and_null_ids_are_told_apart(spark):
    a, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(1, a), (1, other), (2, a + " more"), (None, other + " end"), (None, "null " + a[:40]), (None, "null " + a[:40]), (7, other + " end")]
    for order in (rows, rows[::-1]):
        df = docs(spark, order)
        got = sorted((tuple(r) for r in ngram_join.near_duplicates(df).collect()), key=str)
        assert got == sorted([(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 2), (None, 1, 1, 7), (7, 1, 1, 7), (None, None, 0, None), (None, None, 0, None)], key=str)
        left = sorted((r["doc_id"], r["text"]) if r["doc_id"] else (None, r["text"]) for r in ngram_join.dedup(df).collect() if r["doc_id"])
        assert left == [(1, other), (1, a)]
        assert [r["text"] for r in ngram_join.dedup(df).collect() if r["doc_id"] is None] == ["null " + a[:40]]


def test_a_long_text_and_its_near_copy(spark):
    long = " ".join(f"x{k % 9001}" for k in range(200_000))
    got = ngram_join.near_duplicates(docs(spark, [(1, long), (2, long + " tail"), (3, "short one")])).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_recall_of_the_join_on_data(spark):
    """Of all pairs at the threshold in the test data, by brute force over shared shingles."""
    from kinfold.llm._shared import table

    df = table(spark, str(DATA / "sf0.001"), "documents")
    sets = {}
    for r in df.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        if w:
            sets.setdefault(tuple(w), r["doc_id"])
    grams = {d: {w[i : i + 5] for i in range(max(1, len(w) - 4))} for w, d in sets.items()}
    want = dict.fromkeys(grams, 0)
    for a, b in combinations(grams, 2):
        if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
            want[a] += 1
            want[b] += 1
    got = {r["copy_id"]: r["n_links"] for r in ngram_join.near_duplicates(df).collect() if r["doc_id"] in want}
    assert sum(got[d] for d in want) >= 0.99 * sum(want.values()) > 0 and all(got[d] <= want[d] for d in want)


def test_partners_within_and_across_blocks():
    rnd = np.random.default_rng(4)
    for size in (2, 5, 30):
        keys = rnd.integers(0, 3, (size * 4, 4))
        band = np.repeat(rnd.integers(0, 4, 4), size)
        keys[np.arange(len(keys)), band] = 9
        block, across = rnd.integers(0, 2, len(keys)), np.repeat([True, False, True, False], size)
        first = np.arange(4) * size
        got = ngram_join.with_partners(keys, band, block, across, first)
        for k in range(len(keys)):
            g = k // size
            want = any((not across[k] or block[j] != block[k]) and (keys[j, : band[k]] != keys[k, : band[k]]).all() for j in range(g * size, g * size + size) if j != k)
            assert got[k] == want


def test_packing_needs_few_sequences():
    """Against exact search on small cases, and against the least number that the lengths allow on many pieces."""
    rnd = random.Random(9)

    def least(items, room):
        best = len(items)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in sorted({b: i for i, b in enumerate(bins)}.values()):
                if bins[i] + items[k] <= room:
                    place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best

    used = lambda items, room: sum((r1 - r0) // k for n, r0, r1, _, k, off in packing.plan({n: items.count(n) for n in set(items)}, room) if off == 0)
    mine = exact = 0
    for _ in range(150):
        items = sorted((rnd.randint(1, 15) for _ in range(rnd.randint(1, 9))), reverse=True)
        a, b = used(items, 20), least(items, 20)
        assert b <= a <= b + 1
        mine, exact = mine + a, exact + b
    assert mine <= 1.02 * exact
    for _ in range(3):
        items = [min(2048, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(5000)]
        assert used(items, 2048) <= -(-sum(items) // 2048) + 1


def test_packing_of_the_test_data(spark):
    from kinfold.llm._shared import table

    got = packing.pack(table(spark, str(DATA / "sf0.001"), "documents")).agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("bins")).first()
    assert got["bins"] <= -(-got["n"] // 2048) + 1


def test_quality_of_labelled_documents(spark):
    """The labels of the test data, which the operator never sees."""
    from kinfold.llm._shared import table

    sf = str(DATA / "sf0.01")
    got = quality.assess(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("rejected").cast("int")).alias("share"), F.count("*").alias("n"))
    share = {r["quality"]: r["share"] for r in got.where("quality IS NOT NULL").collect()}
    assert share[1] <= 0.01 and share[0] >= 0.95


def test_quality_odd_rows(spark):
    good = "The river runs past the old mill and the road goes on to the town where people meet on market days."
    rows = [(k, good.replace("mill", f"mill {k}")) for k in range(200)] + [(300, None), (301, ""), (302, " \n\t"), (303, "?! ..."), (5, "$$$$ ~~~~ #### " * 40), (400, (good + " ") * 20_000), (1, good.replace("mill", "mill 1"))]
    df = docs(spark, rows).withColumns({"h": F.lit(1), "pattern": F.lit("p"), "key": F.lit(0)})
    got = quality.assess(df).collect()
    assert all(r["rejected"] and r["score"] == 0 and r["weak_bad"] == 1 for r in got if r["doc_id"] in (300, 301, 302, 303)) and len(got) == len(rows)
    one = [(r["score"], r["pattern"]) for r in got if r["doc_id"] == 1]
    assert len(one) == 2 and one[0] == one[1]
    left = quality.keep(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.where("doc_id < 300").collect()) == sorted([*range(200), 1])
    assert quality.assess(df.where("false")).count() == 0


def test_held_out_toxicity_and_language(spark):
    from kinfold.llm import queries as llm
    from kinfold.llm._shared import table

    sf = str(DATA / "sf0.01")
    tox = llm.op6_toxicity(spark, sf).where("held_out").join(table(spark, sf, "labels").where("toxic IS NOT NULL"), "doc_id").select("predicted", "toxic").collect()
    assert len(tox) > 40 and sum(r["predicted"] > r["toxic"] for r in tox) <= 1 and sum(r["predicted"] == r["toxic"] for r in tox) >= 0.93 * len(tox)
    lang = llm.op10_language_id(spark, sf).where("held_out").join(table(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", "lang", "text"), "doc_id").where("lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in lang) >= 0.99 * len(lang) > 150


def test_pages_that_tie_and_long_pages(spark):
    long = "<body><article>" + "<p>line of text</p>" * 60_000 + "</article></body>"
    rows = [(1, "http://a.org/x", long), (2, "http://a.org/y", "<article><p>one</p></article>"), (2, "http://a.org/y", "<article><p>one</p></article>"), (3, None, "<p>no url")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "path": F.lit(2), "n": F.lit(3), "low": F.lit("l")})
    got = site_style_tree.extract(df).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 4 and text[1] == " ".join(["line of text"] * 60_000) and (text[2], text[3]) == ("one", "no url")
    assert site_style_tree.extract(df.where("false")).count() == 0


def test_paths_too_large_to_broadcast(spark, monkeypatch):
    page = "<body><div class=top>same on every page</div><div class=text>text number {}</div></body>"
    df = spark.createDataFrame([(k, "http://a.org/x", page.format(k)) for k in range(20)], "page_id long, url string, html string")
    want = sorted(map(tuple, site_style_tree.extract(df).collect()))
    assert want[3][2] == "text number 3"
    monkeypatch.setattr(site_style_tree, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, site_style_tree.extract(df).collect())) == want
