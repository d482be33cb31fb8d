"""Operators against plain forms of their rules, over awkward rows and small tables."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sluicewatch.llm import (
    adaptive_rules, chat_bytes, lexical_dag, line_crf, metric_cells, ngram_join, prefix_trie, sp_wfst, suffix_arrays, token_orc, toxicity, warc_zstd, wrappers,
)
from sluicewatch.llm.scratch import new_folder
from tests.llm import data

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return data.documents(spark).cache()


def test_suffix_arrays_order_suffixes():
    order = np.random.default_rng(1)
    for _ in range(50):
        ids = np.append(order.integers(0, 4, order.integers(1, 60)), 0).astype(np.int32)
        def suffix(p):
            return tuple(ids[p : p + int(np.argmin(ids[p:] != 0))][:16])
        found = [suffix(p) for p in suffix_arrays.suffix_array(ids, 16)]
        assert found == sorted(found) and len(found) == (ids != 0).sum()


def plain_matches(text, items, window=13):
    words = [w.decode() for w in suffix_arrays.words((text or "").encode())]
    hit, names = set(), set()
    for name, item in items:
        own = [w.decode() for w in suffix_arrays.words((item or "").encode())]
        n = min(window, len(own))
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                names.add(name)
    return len(words), len(hit), tuple(sorted(names))


@pytest.mark.parametrize("block", [suffix_arrays.BLOCK_BYTES, 60])
def test_contamination(spark, docs, block):
    items = [(1, data.SENTENCE), (2, "one two"), (30, "a b"), (4, ""), (5, None), (None, "birds sing"), (1, data.SENTENCE)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = suffix_arrays.find_matches(docs, bench, block_bytes=block).collect()
    named = [("" if i is None else str(i), t) for i, t in items]
    want = Counter((r.doc_id, *plain_matches(r.text, named)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == want
    for r in got:
        assert (r.longest_match, r.longest_start) == plain_longest(r.text, named)[:2], r.doc_id
        assert (r.longest_item is None) == (r.longest_match == 0)
        assert r.longest_item is None or r.longest_item in plain_longest(r.text, named)[2]
    assert sum(r.longest_match == 21 for r in got) == 3


def plain_longest(text, items):
    """Words and first place of the longest run of a text that an item has, and those items."""
    words, best = [w.decode() for w in suffix_arrays.words((text or "").encode())], (0, None, set())
    for name, item in items:
        own = [w.decode() for w in suffix_arrays.words((item or "").encode())]
        for i in range(len(words)):
            for j in range(len(own)):
                n = 0
                while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                    n += 1
                if n and (n > best[0] or (n == best[0] and i < best[1])):
                    best = n, i, {name}
                elif n and n == best[0] and i == best[1]:
                    best[2].add(name)
    return best


def test_own_longest_matches():
    """Of texts over few words, shard by shard, beside copies and parts of each other."""
    dice = np.random.default_rng(8)
    def text(n):
        return " ".join(f"w{k}" for k in dice.integers(0, 4, n))
    items = [(str(k), text(dice.integers(1, 30))) for k in range(6)]
    texts = [text(dice.integers(0, 40)) for _ in range(30)] + [items[0][1], items[0][1], f"x {items[1][1]} w1 x", ""]
    index = suffix_arrays.Benchmark([(n, x.encode()) for n, x in items], 13)
    found = suffix_arrays._search_chunk(index, [x.encode() for x in texts])
    for x, length, start, item in zip(texts, *(c.to_pylist() for c in found[3:6])):
        want = plain_longest(x, items)
        assert (length, start) == want[:2] and (item in want[2] or not length)


def test_warc_round_trip(spark):
    same = "é" * 80
    rows = [(1, "http://a/ü\r\nx", None), (2, None, same), (3, None, same), (None, "u", same), (2, "z", same), (9, "s", "short"), (10, "s", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = new_folder(spark, "warc")
    warc_zstd.write_archives(warc_zstd.prepared(pages), warc_zstd.train_dictionary(pages), folder)
    got = warc_zstd.read_archives(spark, folder).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == Counter([
        (1, "response", None, 0), (2, "response", None, 160), (2, "response", None, 160), (3, "revisit", 2, 160),
        (None, "revisit", 2, 160), (9, "response", None, 5), (10, "response", None, 5),
    ])
    assert all(r.payload_digest == hashlib.sha256((r.payload if r.payload is not None else same.encode())).hexdigest() for r in got)


@pytest.mark.parametrize("frames, size", [(5, 64 << 20), (1000, 1), (7, 130_000)])
def test_archives_roll_over(spark, monkeypatch, frames, size):
    """Many archives of bounded size, each with its dictionary; clashing columns, a very long page."""
    monkeypatch.setattr(warc_zstd, "ARCHIVE_FRAMES", frames)
    monkeypatch.setattr(warc_zstd, "ARCHIVE_BYTES", size)
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    rows = [(i, f"http://h/{i}", f"<p>page {i % 9} " + "text " * 40 + (long if i == 4 else "")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for name in ("payload", "digest", "first", "value", "N"):
        pages = pages.withColumn(name, F.lit("clash"))
    folder = new_folder(spark, "warc")
    dictionary = warc_zstd.train_dictionary(pages)
    warc_zstd.write_archives(warc_zstd.prepared(pages.coalesce(2)), dictionary, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()
    assert len(files) > 5
    for f in files:
        found = list(warc_zstd.frames_of(bytes(f.content)))
        assert 2 <= len(found) <= frames - 1 and found[0] == warc_zstd._info()
        assert len(f.content) <= max(size, 0) + len(dictionary) + 400_000 + 8 * frames
    got = {r.page_id: r for r in warc_zstd.read_archives(spark, folder).collect()}
    assert len(got) == 40
    for i, _, text in rows:
        first = min(k for k, _, x in rows if x == text)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == first else ("revisit", first))
        assert got[i].payload_digest == hashlib.sha256(text.encode()).hexdigest() and got[i].payload_bytes == len(text.encode())


def test_payloads_are_not_shuffled(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    text = warc_zstd.prepared(pages)._jdf.queryExecution().toString()
    physical = text[text.index("== Physical Plan ==") :]
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical and "hashpartitioning(digest" not in physical


def test_dictionaries_see_different_records(spark):
    """Copies don't crowd out the other payloads, nor beginnings the rest of long ones."""
    dice = np.random.default_rng(3)
    last = "and so ends this page, goodbye to all of our readers until the next one; " * 3
    rows = [(" ".join(map(str, dice.integers(0, 10**9, 4000))) + last,) for _ in range(60)]
    frame = spark.createDataFrame([("copy " * 50,)] * 6000 + rows, "html string")
    assert b"goodbye to all of our readers" in warc_zstd.train_dictionary(frame.repartition(3))


def test_quality_counts(docs):
    def plain(text):
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = Counter(grams)
        covered = {p for k, g in enumerate(grams) if many[g] > 1 for p in range(k, k + 3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))

    want = Counter((r.doc_id, *plain(r.text)) for r in docs.collect())
    for bits in (24, 58):  # with few hash bits windows collide, and texts go the exact way
        adaptive_rules._POSITION_BITS, was = bits, adaptive_rules._POSITION_BITS
        got = adaptive_rules.apply_rules(docs if bits == 24 else docs.where("doc_id <> 6 or doc_id is null")).collect()
        adaptive_rules._POSITION_BITS = was
        found = Counter((r.doc_id, *(r[c] for c in adaptive_rules.COUNTS)) for r in got)
        assert not found - want and sum(found.values()) >= len(docs.collect()) - 1
        assert all(not r.kept for r in got if r.base_failed)


def exact_fences(values, groups):
    """Fences of {(lang, source): sorted values of a measure} from exact quantiles: (least, most)."""
    def at(v, q):
        return v[max(0, math.ceil(len(v) * q) - 1)]
    def three(v):
        return len(v), np.array([at(sorted(v), q) for q in (1 - adaptive_rules.TAIL, 0.5, adaptive_rules.TAIL)])
    def drawn(n, own, towards):
        return (n * own + adaptive_rules.PRIOR_ROWS * towards) / (n + adaptive_rules.PRIOR_ROWS)
    _, overall = three(values)
    out = {}
    for g, own in groups.items():
        n, mine = three(own)
        k, lang = three([v for h, vs in groups.items() if h[0] == g[0] for v in vs])
        out[g] = drawn(n, mine, drawn(k, lang, overall))
    return out


def test_kept_by_exact_quantiles(spark):
    """Fences of the sketches are those of exact quantiles within their error, large groups and small."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = spark.createDataFrame([(-1, "a b " * 30 + " ".join(f"w{k}" for k in range(90)), None, None)], docs.schema)
    rows = adaptive_rules.apply_rules(docs.unionByName(extra).withColumn("Kept", F.lit("x"))).collect()
    good = [r for r in rows if not r.base_failed]
    measures = {
        "symbols_per_word": lambda r: r.n_symbols / r.n_words, "repeated_share": lambda r: r.n_repeat_words / r.n_words,
        "chars_per_word": lambda r: r.word_chars / r.n_words,
    }
    told = 0
    for name, least, two_sided in adaptive_rules.MEASURES:
        if name not in measures:
            continue
        value, groups = measures[name], {}
        for r in good:
            groups.setdefault((r.lang, r.source), []).append(value(r))
        assert sum(len(v) < 200 for v in groups.values()) > 10 and (None, None) in groups
        quantiles = exact_fences([value(r) for r in good], groups)
        for r in good:
            low, median, high = quantiles[r.lang, r.source]
            off = adaptive_rules.ERROR * 2 * (high * 3 + median * 2) + 1e-3
            most = high + max(least, adaptive_rules.REACH * (high - median))
            fewest = low - max(least, adaptive_rules.REACH * (median - low)) if two_sided else -1
            v = value(r)
            if v > most + off or v < fewest - off:
                assert name in r.failed
                told += 1
            elif fewest + off < v < most - off or (not two_sided and v < most - off):
                assert name not in r.failed
                told += 1
    assert told > 2 * len(good)
    assert all(r.kept == (not r.base_failed and not r.failed) for r in rows)


def test_fences_follow_their_group(spark):
    def row(i, source, symbols):
        words = [f"w{i}x{k}" for k in range(80)]
        return (i, " ".join(words) + " #" * symbols, "en", source)
    plain = [row(i, "a", i % 3) for i in range(300)] + [row(i, "b", 60 + i % 3) for i in range(300, 600)]
    odd = [row(900, "a", 70), row(901, "b", 70)]
    docs = spark.createDataFrame(plain + odd, "doc_id int, text string, lang string, source string")
    out = {r.doc_id: r.kept for r in adaptive_rules.apply_rules(docs).collect()}
    assert not out.pop(900) and all(out.values())


def test_each_measure_has_fences_of_its_group(spark):
    """An outlier of one source is an ordinary text of the other, in each of the four measures."""
    def words(i, n=80, size=6):
        return [f"{i:04d}{k:03d}".translate(str.maketrans("0123456789", "abcdefghij")).ljust(size, "x")[:size] for k in range(n)]
    def lines(words, n):
        return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))
    def symbols(i):
        return " ".join(words(i, size=7)) + "#" * 8
    def repeats(i):
        return " ".join(words(i, size=7) + words(i, 12, 7))
    def dup_lines(i):  # lines of two words, too short for repeated windows to tell
        w = words(i, size=7)
        return "\n".join([lines(w, 10), *(x for k in range(0, 4, 2) for x in (" ".join(w[k : k + 2]),) * 2)])
    def long_words(i):
        return " ".join(words(i, size=7)).replace(" ", "yyyy ")
    def short_words(i):
        return " ".join(w[-4:] for w in words(i, size=7))
    odd = {"s": symbols, "r": repeats, "d": dup_lines, "l": long_words, "k": short_words}
    rows = [(i, lines(words(i, size=7), 10), "en", "plain") for i in range(300)]
    rows += [(1000 * n + i, f(i), "en", name) for n, (name, f) in enumerate(odd.items(), 1) for i in range(300)]
    strange = {9000 + n: f(500 + n) for n, f in enumerate(odd.values())}
    rows += [(i, text, "en", "plain") for i, text in strange.items()]
    rows += [(i + 100, text, "en", name) for (i, text), name in zip(strange.items(), odd)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    out = {r.doc_id: r for r in adaptive_rules.apply_rules(docs).collect()}
    found = [[*out[i].failed] for i in strange]
    for i, measure in enumerate(["symbols_per_word", "repeated_share", "dup_line_share", "chars_per_word", "chars_per_word"]):
        assert measure in found[i], (measure, found)
        assert not out[9100 + i].failed and not out[9100 + i].base_failed
    assert all(r.kept for i, r in out.items() if i < 300)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    folder = new_folder(spark, "tokens")
    token_orc.write_tokens(docs, folder, WORDS)
    rows = sorted(token_orc.with_crc(token_orc.placed(token_orc.read_tokens(spark, folder))).collect(), key=lambda r: r.start)
    encoder, at = Tokenizer.from_file(WORDS), 0
    want = Counter()
    for r in docs.collect():
        ids = [*encoder.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    chosen = token_orc.read_tokens(spark, folder, [5])
    assert chosen.count() == 2
    assert re.search(r"PushedFilters: \[[^]]*doc_id", chosen._jdf.queryExecution().toString())


def test_words_encode_as_texts():
    from tokenizers import Tokenizer

    plain, encode, dice = Tokenizer.from_file(WORDS), token_orc.WordEncoder(WORDS, 2), np.random.default_rng(1)
    letters = list("aZbst'éİſKΣσ.,!&#$*;:?<|>12²_- \t\n\xa0\x85\x1c\x00\u0301\u0338") + ["<|endoftext|>", "'s"]
    texts = ["".join(dice.choice(letters, dice.integers(0, 25))) for _ in range(5000)]
    texts += ["<|endoftext|>.", "<|ENDOFTEXT|>", "IT'S!!", "x.'s", "a.\u0301", "ſ.", "a.", "a", "."]
    assert encode.lowers and encode.cuts
    for some in (texts[i : i + 700] for i in range(0, len(texts), 700)):
        ids, bounds = encode([x.encode() for x in some])
        got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [[*plain.encode(x, add_special_tokens=False).ids, 2] for x in some]


def test_words_are_learned_in_bounds(monkeypatch):
    """The tokenizer gets few words at a time, words of letters none at all, and words used again stay known."""
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(WORDS), token_orc.WordEncoder(WORDS, 2)
    got = []
    class Counting:
        model = plain.model
        def encode_batch_fast(self, words, **kinds):
            got.append(words)
            return plain.encode_batch_fast(words, **kinds)
    encode.tokenizer = Counting()
    monkeypatch.setattr(token_orc, "REMEMBERED", 3000)
    letters = list("abcdeéßœñöжωσςſ")
    dice = np.random.default_rng(3)
    words = ["".join(dice.choice(letters, 6)) for _ in range(2000)]
    odd = [f"{w}{n}" for n, w in enumerate(words * 5)]
    for words in (words, [f"{w}*!" for w in words], odd, ["again"] * 3 + odd[:4000], ["again", "ÀÉ", "é\u0301", "क़"], words):
        ids, bounds = encode([" ".join(words).encode()])
        assert ids.tolist() == [*plain.encode(" ".join(words), add_special_tokens=False).ids, 2]
        assert bounds.tolist() == [0, ids.size]
    assert max(map(len, got)) <= 4096
    assert not [w for ws in got for w in ws if set(w) <= set(letters)]
    assert b"again" in encode.place and len(encode.place) < 5000


def test_rarity_tells_unique_grams_from_shared_ones(spark):
    """Few prefix n-grams are shared ones while sets have enough of their own, among many others."""
    dice = np.random.default_rng(9)
    def words(n):
        return [f"w{x}" for x in dice.integers(0, 1 << 40, n)]
    common = words(60)
    texts = [" ".join([*words(140), *common]) for _ in range(100)] + [" ".join(words(2000)) for _ in range(4000)]
    docs = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "uid bigint, text binary").repartition(4).cache()
    rows = docs.selectExpr("uid AS id", "uid", "text")
    sketch = ngram_join._sketch(ngram_join._digests(rows, 5).where("row IS NOT NULL"))
    assert sketch.nbytes <= 16 << 20
    shingler = ngram_join.Shingler()
    shared = {int(g) for g in shingler.set_of(" ".join(common).encode()).view(np.int64)}
    first = ngram_join._prefixes(rows.where("uid < 100"), sketch, 5, 75).select("h").collect()
    assert len(first) > 100 * 45 and sum(r.h in shared for r in first) == 0


def test_main_text(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    def article(page):
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        body = re.sub(r"<[^>]*$", "", re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>|<br>", " ", body)))
        return " ".join(html.unescape(body).split())
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert got == {r.page_id: article(r.html) for r in pages.collect()}


def test_main_text_without_tags_to_go_by(spark):
    """Slots that vary are content; what every page of the host repeats is template."""
    def page(i):
        story = f"<div><p>Story {i} tells of {i * 7} things &amp; more, and then it goes on for a while.</p><p>Read on in print</p></div>"
        return f"<html><body><div>Our site for you</div>{story}<div><a href=x>All rights</a></div><div class='comments'><p>me {i} too</p></div>" + "<div>" * 300
    rows = [(i, "http://h.example/x", page(i)) for i in range(12)] + [(50, None, None), (51, "x", ""), (52, "http://h.example/", "<p>a<b"), (53, "http://one.example/", "just text &lt; here")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    for i in range(12):
        assert got[i] == f"Story {i} tells of {i * 7} things & more, and then it goes on for a while."
    assert got[50] == got[51] == "" and len(got) == len(rows)


@pytest.mark.parametrize("pages_of_host", [1, 2, 8])
def test_depth_changes_nothing(spark, pages_of_host):
    """Under 10, 500 or 5,000 blocks the text of a page is the same, tagged or not."""
    def page(i, depth, tag):
        story = f"<{tag}><h1>Title {i}</h1><p>Story {i} goes on for quite a while.</p><nav>skip</nav></{tag}>"
        rest = "<div class=comments><p>a reader writes</p></div><div><a href=x>All rights</a></div><footer>end</footer>"
        return "<html><body>" + "<div>" * depth + "<div class=menu>menu</div>" + story + rest + "</div></i></span></li>" * depth
    rows = [
        (1000 * k + i, f"http://{tag}{depth}.example/{i}", page(i, depth, tag))
        for k, (tag, depth) in enumerate((t, d) for t in ("article", "section") for d in (10, 500, 5000))
        for i in range(pages_of_host)
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    for i in range(pages_of_host):
        for k in range(3):
            assert got[1000 * k + i] == f"Title {i} Story {i} goes on for quite a while."
            assert got[1000 * (3 + k) + i] == got[3000 + i]
        assert f"Story {i} goes on for quite a while." in got[3000 + i] and "reader" not in got[3000 + i]


def test_pages_with_clashing_columns_and_a_very_long_one(spark):
    long = " ".join(f"word{k}" for k in range(200_000))
    rows = [(i, f"http://h.example/{i}", f"<nav>menu</nav><article><p>{i} {long if i == 3 else 'short'}</p>" + "<p>x" * (20_000 * (i == 4)) + "</article>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for name in ("text", "host", "rules", "digest", "shape", "runs"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert got[0] == "0 short" and got[3] == f"3 {long}" and got[4] == "4 short" + " x" * 20_000


def test_copies_of_one_page_keep_their_text(spark):
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>Body text.</p></article></body></html>"
    pages = spark.createDataFrame([(i, "http://h.example/", page) for i in range(20)], "page_id bigint, url string, html string")
    assert {r.text for r in wrappers.extract(pages.repartition(4)).collect()} == {"T Body text."}


def test_copies_in_many_tasks_count_once(spark):
    """The copied page keeps its text beside other pages of its host, however they are dealt."""
    def page(i):
        body = "".join(f"<p>Paragraph {k} of page {i}.</p>" for k in range(10))
        return f"<html><body><article><h1>Title {i}</h1>{body}</article></body></html>"
    want = {i: " ".join([f"Title {i}", *(f"Paragraph {k} of page {i}." for k in range(10))]) for i in range(6)}
    rows = [(100 + i, "http://h.example/", page(0)) for i in range(60)] + [(i, "http://h.example/", page(i)) for i in range(1, 6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for parts in (1, 64):
        got = {r.page_id: r.text for r in wrappers.extract(pages.repartition(parts)).collect()}
        assert got == {i: want[0 if i >= 100 else i] for i, _, _ in rows}


def test_large_templates_lose_nothing(spark):
    """A template of over 600 nodes, and over 24 constant texts in one slot, are known whole."""
    tall = "".join(f"<div><ul><li>Entry {k} of ours</li></ul></div><p>Rule {k} of ours</p>" for k in range(200))
    wide = "".join(f"<p>Notice {k} of ours</p>" for k in range(40))
    def page(i, constant):
        own = "".join(f"<p>Page {i} says {k} at some length.</p>" for k in range(60))
        return f"<html><body>{constant}<article>{wide}{own}</article></body></html>"
    rows = [(i, "http://h.example/", page(i, tall)) for i in range(8)] + [(i, "http://w.example/", page(i, "")) for i in range(8, 16)]
    bare = "<html><body><table>" + "".join(f"<tr><td>Cell {k}</td></tr><ul><li>Item {k}</li></ul>" for k in range(200)) + "</table>"
    rows += [(i, "http://b.example/", f"{bare}<div><p>Page {i} says so at some length.</p></div></body></html>") for i in range(16, 24)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(pages.repartition(3)).collect()}
    for i in range(16):
        assert got[i] == " ".join(f"Page {i} says {k} at some length." for k in range(60))
    for i in range(16, 24):
        assert got[i] == f"Page {i} says so at some length."


def test_links_of_awkward_rows(docs):
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs).collect()), key=repr)
    assert got == data.linked([(r.doc_id, r.text) for r in docs.collect()])


def test_links_in_large_groups(spark):
    """One text with few words changed, many times over: families, blocks, leaders."""
    order = np.random.default_rng(5)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in order.choice(60, order.integers(0, 4), replace=False):
            words[k] = f"z{order.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, f"u{i} " + " ".join(base[:30])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    was = ngram_join.BLOCK_GRAMS
    ngram_join.BLOCK_GRAMS = 1500
    try:
        got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs).collect()), key=repr)
    finally:
        ngram_join.BLOCK_GRAMS = was
    assert got == data.linked(rows)


def test_one_of_each_component_stays(docs):
    left = ngram_join.deduplicated(docs)
    assert left.columns == docs.columns
    want = Counter(i for i, n, c in data.linked([(r.doc_id, r.text) for r in docs.collect()]) if n and i == c)
    ids = Counter(r.doc_id for r in left.collect() if r.text and r.text.split())
    assert ids == want


def test_chat_round_trip(spark):
    rows = [
        (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
        (None, 1, None, None), (None, None, "a:b#<\\", "x\n"), (5, 1, "assistant", None), (5, 1, "assistant", None),
        (6, 2, "assistant", "é" * 5000), (6, 1, "user", ""),
    ]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in chat_bytes.format_conversations(frame).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        read = chat_bytes.read_turns(bytes(out[conv].formatted))
        assert [(a.decode(), b.decode()) for a, b in read] == [(r, x) for _, r, x in own]
        spans = [bytes(out[conv].formatted)[a:b] for a, b in zip(out[conv].loss_starts, out[conv].loss_ends)]
        assert [chat_bytes._unescaped(s).decode() for s in spans] == [x for _, r, x in own if r == "assistant"]


@pytest.mark.parametrize("block", [1, 300, 5000])
def test_long_conversations_are_several_blocks(spark, monkeypatch, block):
    """Blocks follow one another, are cut between turns, and read back as the whole."""
    monkeypatch.setattr(chat_bytes, "BLOCK_BYTES", block)
    dice = np.random.default_rng(6)
    rows = [
        (c, t, ["user", "assistant", None][t % 3], "é#\\<x" * int(dice.integers(0, 12)))
        for c in (None, 1, 2, 3, 9) for t in range({1: 400, 9: 1}.get(c, 15))
    ] + [(7, 0, "assistant", "y" * 20_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for name in ("block", "last", "formatted", "Chars"):
        frame = frame.withColumn(name, F.lit("clash"))
    formatted = new_folder(spark, "chats")
    chat_bytes.format_conversations(frame).write.parquet(formatted)
    formatted = spark.read.parquet(formatted)
    blocks = formatted.orderBy("conv_id", "block").collect()
    assert len([b for b in blocks if b.conv_id == 1]) > (20_000 // block if block > 1 else 300) / 8
    for b in blocks:
        assert len(chat_bytes.read_turns(bytes(b.formatted))) == b.n_turns
    got = {r.conv_id: tuple(r)[1:] for r in chat_bytes.digests(formatted).collect()}
    monkeypatch.undo()
    whole = chat_bytes.format_conversations(frame)
    assert whole.where("block > 0 OR NOT last").count() == 0
    assert got == {r.conv_id: tuple(r)[1:] for r in chat_bytes.digests(whole).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x) for c, t, r, x in rows if c == conv))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv][:4] == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (line_crf, "quality")])
def test_classifiers_score_awkward_rows(spark, docs, module, label):
    for marks in (data.labels(spark, docs, label), data.labels(spark, docs, label).limit(0)):
        model = module.fit_model(docs, marks)
        rows = module.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        by_text = {}
        for r in rows:
            assert by_text.setdefault(r.text, r.score) == r.score
    assert all(r.predicted == (label == "quality") for r in rows)


def test_toxicity_by_plain_counts():
    """Ratios and scores against n-grams counted as strings."""
    order = np.random.default_rng(11)
    common = ["the", "tree", "stands", "near", "our", "old", "house", "étoile"]
    texts = [[common[k] for k in order.integers(0, 8, 30)] for _ in range(60)]
    labels = np.array([i % 2 for i in range(60)], dtype=float)
    for i in range(1, 60, 2):
        texts[i][:2] = ["Badword", "vileness"]
    lines = [" ".join(t) for t in texts]

    def counts(line):
        padded = f" {' '.join(line.lower().split())} "
        return Counter(padded[k : k + n] for n in toxicity.ORDERS for k in range(len(padded) - n + 1))

    def place(gram):
        h = ord(gram[0])
        for c in gram[1:]:
            h = (h * 0x01000193 ^ ord(c)) % 2**32
        h = h * 0x85EBCA6B % 2**32
        return (h ^ h >> 13) * 0xC2B2AE35 % 2**32 >> 32 - toxicity.BITS

    plain = [counts(x) for x in lines]
    grams = set().union(*plain)
    assert len({place(g) for g in grams}) == len(grams)
    ratios = toxicity.log_count_ratios([toxicity.features(x.encode()) for x in lines], labels)
    for g in grams:
        sums = [1 + sum(np.log1p(c[g]) for c, y in zip(plain, labels) if y == k) for k in (0, 1)]
        seen = [sum(g in c for c, y in zip(plain, labels) if y == k) for k in (0, 1)]
        want = np.log(sums[1] / 32 / (sums[0] / 32))
        if sum(seen) < 3 or abs(want) < 3 * (1 / (seen[0] + 1) + 1 / (seen[1] + 1)) ** 0.5:
            want = 0
        assert np.isclose(ratios[place(g)], want, atol=1e-5), g
    weights, bias = toxicity.fit([x.encode() for x in lines], labels, 0.5)
    used = weights != 0
    for line, c, y in zip(lines, plain, labels):
        z = bias + sum(weights[place(g)] * np.log1p(n) for g, n in c.items())
        distinct, values = toxicity.features(line.encode(), used)
        assert np.isclose(bias + weights[distinct] @ values, z, atol=1e-4) and (z > 0) == (y == 1)


def test_a_few_words_in_a_very_long_text_are_found():
    calm = " ".join(f"calm{k % 50} water" for k in range(60))
    texts = [calm.encode()] * 40 + [(calm + " badword vileness badword").encode()] * 40
    weights, bias = toxicity.fit(texts, np.repeat([0.0, 1.0], 40), 0.5)
    for words, toxic in (("", False), (" badword vileness badword", True)):
        distinct, values = toxicity.features(((calm + " ") * 300 + words).encode(), weights != 0)
        assert (bias + weights[distinct] @ values >= 0) == toxic


def test_columns_named_like_results_or_helpers(spark, tmp_path):
    """Names are compared as Spark does; columns that clash with no result stay as they are."""
    rows = [(1, data.SENTENCE), (2, data.NEAR), (3, None), (4, ""), (5, "one two " * 40)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 6)], "doc_id bigint, toxic int, quality int")
    bench = spark.createDataFrame([(1, data.SENTENCE)], "item_id bigint, text string")
    names = "Score Predicted N_Words Kept Failed Base_Failed N_Hit Item_Ids Hit_Words Longest_Match __earlier Piece_Ids Decoded uid __uid row key".split()
    clash = plain
    for name in names:
        clash = clash.withColumn(name, F.lit("clash"))
    encoded = sp_wfst.encode(clash, PIECES)
    for results, got in (
        (("score", "predicted"), toxicity.score(clash, toxicity.fit_model(clash, marks))),
        (("score", "predicted"), line_crf.score(clash, line_crf.fit_model(clash, marks))),
        (("kept", "n_words", "failed"), adaptive_rules.apply_rules(clash)),
        (("n_hit", "longest_match"), suffix_arrays.find_matches(clash, bench, block_bytes=10)),
        (("piece_ids",), encoded),
        (("decoded",), sp_wfst.decode(encoded, PIECES)),
        (("ids_crc32",), sp_wfst.digests(encoded, PIECES)),
        ((), ngram_join.deduplicated(clash)),
    ):
        lower = [c.lower() for c in got.columns]
        assert len(set(lower)) == len(lower) and set(results) <= set(got.columns)
        found = got.collect()
        assert len(found) in (4, 5) and all(r[name] != "clash" for r in found for name in results)
        assert all(r["key"] == "clash" and r["__uid"] == "clash" for r in found)


def test_marginals_are_those_of_all_labellings():
    chains = line_crf.Chains([b"one\ntwo three\nfour", b"x"])
    order = np.random.default_rng(3)
    unary, moves = order.normal(size=4), order.normal(size=(2, 2))
    good, _, _ = line_crf.forward_backward(chains, unary, moves)
    where = [chains.start[t] + 0 for t in range(3)]
    weights = {}
    for labels in np.ndindex(2, 2, 2):
        score = sum(unary[w] * y for w, y in zip(where, labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:]))
        weights[labels] = np.exp(score)
    for t, w in enumerate(where):
        assert np.isclose(good[w], sum(v for k, v in weights.items() if k[t]) / sum(weights.values()))


def test_pieces_are_the_library_s(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    more = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    both = docs.select("doc_id", "text").unionByName(more)
    rows = sp_wfst.decode(sp_wfst.encode(both, PIECES), PIECES).collect()
    assert len(rows) == both.count()
    for r in rows:
        assert r.piece_ids == library.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_words_are_composed_in_batches(monkeypatch):
    """Any words together as each alone; only long ones take a path of their own."""
    encoder, dice = sp_wfst.Encoder(PIECES), np.random.default_rng(5)
    machine, alone = encoder.machine, sp_wfst.Transducer(encoder.machine.model)
    letters = list("abcdeinrstéßñ▁_-.,!*#$0123 ²中文字𝄞\x00́Ж")
    words = ["".join(dice.choice(letters, dice.integers(0, 14))) for _ in range(3000)]
    words += ["".join(dice.choice([*machine.id_of], dice.integers(1, 5))) for _ in range(3000)]
    words += ["a" * 1500, "", "ab" * 400, "▁" * 900, "中"]
    monkeypatch.setattr(sp_wfst, "BATCH_CHARS", 5000)
    monkeypatch.setattr(sp_wfst, "NEIGHBOUR_BITS", 10)
    machine._pair, machine._verdict = machine._pair[: 1 << 10], machine._verdict[: 1 << 10]
    ids, sizes = machine.all_encoded(words)
    ends = np.cumsum(sizes)
    assert [ids[a:b].tolist() for a, b in zip(ends - sizes, ends)] == [alone.encoded(w) for w in words]
    monkeypatch.setattr(machine, "shortest", lambda part: 1 / 0)
    got, bounds = encoder([b"many small birds sing", None, "Größe 中文".encode()])
    assert got.size == bounds[-1] and bounds[1] == bounds[2]


def test_scored_path_is_the_least():
    """A unigram model, against all segmentations."""
    machine = sp_wfst.Transducer.__new__(sp_wfst.Transducer)
    pieces = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.2, "aba": -3.9}
    model = sp_wfst.Model.__new__(sp_wfst.Model)
    model.pieces, model.scores = list(pieces), list(pieces.values())
    model.kinds, model.type, model.dummy_prefix = [sp_wfst.NORMAL] * len(pieces), sp_wfst.UNIGRAM, False
    machine.__init__(model)
    def best(text):
        if not text:
            return 0.0
        return max((pieces[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces))
    for text in ("a", "ab", "aba", "abab", "babaab", "aabbabaabba"):
        ids = machine.shortest(text)
        assert "".join(model.pieces[i] for i in ids) == text
        assert np.isclose(sum(model.scores[i] for i in ids), best(text))


def plain_vector_links(rows, cosine=0.93):
    """(id, links, least linked id, kept) of every row, by comparing all pairs."""
    def unit(v):
        a = np.array([np.nan if x is None else x for x in v or []], dtype=float)
        return a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()) if a.size and np.isfinite(a).all() and a.any() else None
    units = [unit(v) for _, v, _ in rows]
    links, root = [set() for _ in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = units[i], units[j]
        if rows[i][2] is not None and rows[i][2] == rows[j][2] and x is not None and y is not None and x.size == y.size and x @ y >= cosine:
            links[i].add(j)
            links[j].add(i)
            root = [root[i] if r == root[j] else r for r in root]
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    return Counter((rows[k][0], len(links[k]), least[root[k]], rows[k][0] == least[root[k]]) for k in range(len(rows)))


def vectors(size, n, seed):
    """Evenly spread vectors, a tight and a loose group, a chain, and copies."""
    dice = np.random.default_rng(seed)
    spread = dice.normal(size=(n, size))
    tight = dice.normal(size=size) + 0.05 * dice.normal(size=(n, size))
    loose = dice.normal(size=size) + dice.uniform(0.1, 0.6, (n, 1)) * dice.normal(size=(n, size))
    turn = 0.35 * np.arange(n // 4)[:, None]
    chain = np.cos(turn) * np.eye(size)[0] + np.sin(turn) * np.eye(size)[1]
    return np.concatenate([spread, tight, loose, chain, np.repeat(spread[:3], 5, axis=0) * 2]).astype(np.float32)


@pytest.mark.parametrize("cell_bytes, block_bytes, pivot_bytes, copy_cost", [
    (1 << 20, 16 << 20, 1 << 20, 1e5), (1, 1, 1 << 20, 1e5), (1, 16 << 20, 1 << 20, 0), (1, 1, 5 * 8 * 6, 0), (1, 1, 1, 0),
])
def test_vector_links(spark, monkeypatch, cell_bytes, block_bytes, pivot_bytes, copy_cost):
    """Whole labels, few and many cells, several blocks in a cell, and blocks without pivots."""
    monkeypatch.setattr(metric_cells, "COPY_COST", copy_cost)
    found = vectors(6, 150, 3)
    rows = [(k * 7 % 1000, v.tolist(), k % 2 if k % 11 else 2) for k, v in enumerate(found)]
    odd = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [1.0] * 5, [1e-30] * 6, [3e38] * 6]
    rows += [(2000 + k, v, 0) for k, v in enumerate(odd)]
    rows += [(3000, found[0].tolist(), None), (3001, found[0].tolist(), None), (None, found[0].tolist(), 0), (None, [1.0] * 5, 7), (None, [1.0] * 5, 7), (4, found[5].tolist(), 0), (4, found[5].tolist(), 0)]
    schema = "vec_id bigint, embedding array<float>, label int"
    frame = spark.createDataFrame(rows, schema).withColumn("node", F.lit(1)).withColumn("n_links", F.lit("x"))
    sizes = {"cell_bytes": cell_bytes, "block_bytes": block_bytes, "pivot_bytes": pivot_bytes}
    got = metric_cells.near_duplicates(frame.repartition(5), **sizes).collect()
    want = plain_vector_links(rows)
    assert Counter((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in got) == want
    assert metric_cells.near_duplicates(frame.limit(0)).collect() == []


def test_as_many_pivots_as_pay():
    """One where vectors are spread evenly, many where they lie in groups."""
    dice, bounds = np.random.default_rng(7), metric_cells.Bounds(0.93)
    def chosen(points):
        points /= np.linalg.norm(points, axis=1)[:, None]
        pivots = metric_cells.choose_pivots(points, 30, bounds)
        return metric_cells.paying_pivots(points, pivots, 20_000, bounds)
    assert len(chosen(dice.normal(size=(2500, 64)))) == 1
    centres = dice.normal(size=(30, 64))
    assert len(chosen(np.repeat(centres, 80, axis=0) + 0.1 * dice.normal(size=(2400, 64)))) == 30


def test_cells_miss_no_partner():
    """Every two vectors that link meet in the home cell of each, and few others do."""
    bounds, points = metric_cells.Bounds(0.93), vectors(6, 400, 9).astype(float)
    points /= np.linalg.norm(points, axis=1)[:, None]
    pivots = metric_cells.choose_pivots(points[::3], 20, bounds)
    assert len(pivots) > 5 and (pivots @ pivots.T - np.eye(len(pivots))).max() < np.cos(1.5 * bounds.reach)
    cosines, angles, home, shell = bounds.homes(points, pivots)
    angle = angles[np.arange(home.size), home]
    low, high = np.full((len(pivots), 3), np.inf), np.full((len(pivots), 3), -np.inf)
    np.minimum.at(low, (home, shell), angle)
    np.maximum.at(high, (home, shell), angle)
    may = bounds.candidates(cosines, angles, home, pivots, low, high)
    linked = points @ points.T >= 0.93
    for y, x in zip(*np.nonzero(linked)):
        assert may[y, home[x], shell[x]]
        assert not (home[x] == home[y] and shell[x] == shell[y] == metric_cells.CORE) or linked[x, y]
    cores = [np.flatnonzero((home == p) & (shell == metric_cells.CORE)) for p in range(len(pivots))]
    assert max(map(len, cores)) > 100 and all(linked[np.ix_(c, c)].all() for c in cores)
    assert may.sum() < 0.4 * may.size


def plain_trie(rows):
    """Every prefix of every rebuilt conversation, in a dictionary."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, role or "", digest), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    nodes = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    children = Counter(s[:-1] for s in nodes if s)
    leaves, saved = Counter(), Counter()
    for s, members in nodes.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(members) - 1) * len(s[-1][1]) if s else 0
    ends = {s: ",".join(str(c) for c in sorted(whole) if whole[c] == s) for s in nodes}
    return Counter(
        (min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(ends[s].encode()).hexdigest())
        for s, m in nodes.items()
    )


def found_trie(frame, **more):
    return Counter(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(frame)), **more).collect()))


TALK = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("shard_turns, width", [(1 << 20, 64), (1 << 20, 3), (40, 2), (7, 64)])
def test_prefix_trie(spark, shard_turns, width, monkeypatch):
    """Awkward rows, deep chains, copies and shared beginnings, over few and many shards."""
    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    dice = np.random.default_rng(4)
    rows = [(None, 1, "user", "lost"), (-7, 0, "user", "a"), (-7, 1, None, None), (-7, None, "user", "first"), (-107, 3, "x", "y")]
    rows += [(-100, 0, "user", "b"), (0, 5, "user", ""), (0, 5, "user", ""), (0, 5, "assistant", "é𝄞"), (0, 4, "system", "s" * 3000)]
    for c in range(1, 160):
        rows += [(c, t, "user" if t % 2 else "assistant", f"t{dice.integers(0, 2)}") for t in range(int(dice.integers(1, 9)))]
    rows += [(c, t, "u", "same") for c in range(200, 240) for t in range(40)] + [(300, t, "u", "same") for t in range(300)]
    frame = spark.createDataFrame(rows, TALK).withColumn("key", F.lit("x")).withColumn("c", F.lit(1)).withColumn("least", F.lit(1))
    assert found_trie(frame.repartition(3), shard_turns=shard_turns) == plain_trie(rows)


def test_tries_of_little(spark):
    frame = spark.createDataFrame([(None, 1, "u", "x")], TALK)
    assert not found_trie(frame) and not found_trie(frame.limit(0))
    for rows in ([(1, 0, "u", "x")], [(c, 0, "u", "x") for c in range(1, 20)]):
        assert found_trie(spark.createDataFrame(rows, TALK)) == plain_trie(rows)


def plain_search(rows, items, k):
    """Every document against every item, one term at a time."""
    held = [(i, Counter(w)) for i, text in rows if (w := suffix_arrays.words((text or "").encode()))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for name, text in items:
        scores = []
        for i, c in held:
            m, score = 50 + 50 * sum(c.values()) * n_docs // n_terms, 0
            for t in set(suffix_arrays.words((text or "").encode())) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(name, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("k, block", [(50, lexical_dag.BLOCK_TERMS), (2, 5)])
def test_lexical_search(spark, docs, k, block, monkeypatch):
    monkeypatch.setattr(lexical_dag, "HELD_ROWS", 1)
    monkeypatch.setattr(lexical_dag, "BATCH_SUMS", 100)
    items = [(1, data.SENTENCE), (2, "one two"), (30, "a b w5 x7 w9"), (4, ""), (5, None), (None, "birds sing"), (1, data.SENTENCE), (6, "nowhere")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    many = [(100 + i, f"birds w{i % 7} x{i % 5} two " * (1 + i % 4)) for i in range(200)]
    both = docs.withColumn("rank", F.lit(0)).unionByName(
        spark.createDataFrame(many, "doc_id bigint, text string"), allowMissingColumns=True
    )
    got = lexical_dag.search(both, bench, k, block_terms=block).collect()
    assert Counter(map(tuple, got)) == plain_search(rows + many, items, k)
    assert lexical_dag.search(docs.limit(0), bench).collect() == lexical_dag.search(docs, bench.limit(0)).collect() == []


def test_shared_sums_are_the_items_own_sums():
    dice = np.random.default_rng(2)
    items = [sorted({int(t) for t in dice.zipf(1.4, 30) if t <= 60} | {int(dice.integers(0, 60))}) for _ in range(80)]
    sums = lexical_dag.SharedSums(items, 61)
    assert sums.levels and sums.operands.size < sum(map(len, items)) / 2
    values = dice.integers(0, 10**12, (61, 5))
    term, document = (a.ravel() for a in np.indices(values.shape))
    got = sums.scores(document, term, values.ravel(), 5)
    assert (got == np.array([values[i].sum(axis=0) for i in items])).all()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    talk = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    folder, archive = new_folder(spark, "tokens"), new_folder(spark, "warc")
    token_orc.write_tokens(none, folder, WORDS)
    warc_zstd.write_archives(warc_zstd.prepared(pages), warc_zstd.train_dictionary(pages), archive)
    for frame in (
        suffix_arrays.find_matches(none, bench), adaptive_rules.apply_rules(none), ngram_join.near_duplicates(none),
        ngram_join.deduplicated(none), wrappers.extract(pages), sp_wfst.decode(sp_wfst.encode(none, PIECES), PIECES),
        chat_bytes.digests(chat_bytes.format_conversations(talk)),
        token_orc.with_crc(token_orc.placed(token_orc.read_tokens(spark, folder))), warc_zstd.read_archives(spark, archive),
    ):
        assert frame.collect() == []
    assert all(r.n_hit == 0 for r in suffix_arrays.find_matches(docs, bench).collect())
