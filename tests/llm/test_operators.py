"""Each operator over nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import gzip
import hashlib
import html
import io
import itertools
import json
import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm import byte_bpe, fingerprints, jaccard_join, language_id, packing, quality_rules, rule_ensemble, tool_calls, toxicity, warc

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n int, v string, host int, words string, queue int, component long"


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]]), beside columns whose names the operators use themselves."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(i, t, lang, src, 7, 0.5, "k", 3, "v", 1, "w", 2, 9) for i, t, lang, src in full], SCHEMA)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n))


LONG = words(random.Random(1), 20_000)
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "nobody's text"), (None, None), (6, LONG), (7, "ünï çode 🙂\x00 <b>"), (2**60, "far")]


# 1


def test_warc_records_link_and_keep_what_the_source_said(spark):
    page = "<html lang='de'><head><title> A  <b</title></head><body><!-- no --><script>x</script><p>a &lt;b&gt; &amp;amp; &#65;&#x1F642;&#0; c</p><a href=\"/x\">l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", page, "x"), (2, None, None, "x"), (1, "http://a/", page, "x")], "page_id long, url string, html string, block string")
    got = warc.derive(warc.responses_of_pages(pages), ["page_id"]).collect()
    assert len(got) == 6
    first = {r.record_type: r for r in got if r.page_id == 1}
    assert first["conversion"].block == "a <b> &amp; A🙂� c\nl"
    assert "title: A" in first["metadata"].block and "outlink: /x" in first["metadata"].block and "language: de" in first["metadata"].block
    assert first["conversion"].refers_to == first["metadata"].refers_to != first["conversion"].record_id
    assert first["conversion"].block_digest == "sha256:" + hashlib.sha256(first["conversion"].block.encode()).hexdigest()
    assert first["conversion"].payload_digest == "sha256:" + hashlib.sha256(page.encode()).hexdigest()
    assert first["conversion"].source_headers.startswith("HTTP/1.1 200 OK")
    empty = [r for r in got if r.page_id == 2 and r.record_type == "conversion"][0]
    assert (empty.block, empty.content_length, empty.target_uri) == ("", 0, None)
    assert warc.derive(warc.responses_of_pages(pages.limit(0)), ["page_id"]).count() == 0


def test_warc_files_are_read_and_written(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n<p>hi</p>"
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw.replace(b"response", b"request.")))
    responses = warc.read_responses(spark, str(tmp_path))
    r = responses.collect()
    assert [(x.record_id, x.payload, x.source_headers) for x in r] == [("<urn:1>", "<p>hi</p>", "HTTP/1.1 200 OK\r\nX: 1")]
    out = warc.serialised(warc.derive(responses, []), []).collect()
    head, block = next(warc.parse_records(io.BytesIO(next(x.warc for x in out if "conversion" in x.warc).encode())))
    assert (head["warc-refers-to"], head["warc-type"], block) == ("<urn:1>", "conversion", b"hi")


def test_broken_and_coded_responses(spark, tmp_path):
    def record(body, length=None, kind=b"response"):
        return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %s\r\n\r\n%s\r\n\r\n" % (kind, zlib.crc32(body), length or str(len(body)).encode(), body)

    plain = b"HTTP/1.1 200 OK\r\n\r\none"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\ntwo\r\n2\r\n !\r\n0\r\n\r\n"
    packed_ = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"three")
    wrong = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nfour"
    raw = [record(plain), record(plain, b"many"), record(b"x", kind=b"request"), record(chunked), record(packed_), record(wrong)]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw))[:-40])
    (tmp_path / "c.warc").write_bytes(b"")
    got = [r.payload for r in warc.read_responses(spark, str(tmp_path), batch=2).collect()]
    for payload, least in (("one", 2), ("two !", 1), ("three", 1), ("four", 1), ("", 1)):
        assert got.count(payload) >= least


def test_references_are_resolved_once(spark):
    texts = ["&amp;lt; &copy;&middot;&NotEqualTilde;&fjlig; &unknown; &amp &; & &#65;&#x1F642;&#0;&#xD800;&#1114112; &#99999999; &CounterClockwiseContourIntegral;x", "", "no reference", "&lt;&gt;&quot;&apos;&nbsp;&"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    got = {r.k: r.r for r in frame.select("k", warc.resolved(F.col("t")).alias("r")).collect()}
    for k, t in enumerate(texts):
        want = html.unescape(t.replace("&amp ", "&\0amp ").replace("&#0;", "\ufffd").replace("&#99999999;", "&\0#99999999;")).replace("\0", "")
        assert got[k] == want
    assert got[len(texts)] is None or got[len(texts)] == ""


def test_kept_columns_with_the_names_of_derived_ones(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "mine")], "page_id long, url string, html string, r string")
    responses = warc.responses_of_pages(pages).withColumn("block", F.lit("mine")).withColumn("r", F.lit("r"))
    got = warc.derive(responses, ["page_id", "block", "r"])
    assert got.columns[:2] == ["page_id", "r"] and got.columns.count("block") == 1
    assert {r.block for r in got.where("record_type = 'conversion'").collect()} == {"x"}


# 2


def test_text_counts_match_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab #\n|ü ") for _ in range(rng.randint(0, 60)))
        split = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        windows = [tuple(split[i : i + 3]) for i in range(len(split) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        want = (len(split), sum(map(len, split)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert quality_rules.text_counts(text) == want, repr(text)


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    rng = random.Random(3)
    shared = words(rng, 80)
    rows = [(i, shared + "\n" + words(rng, 100), None, "a") for i in range(30)] + [(100 + i, shared.upper() + "\n" + words(rng, 20), None, "a") for i in range(30)]
    rows += [(200, shared + "\n" + words(rng, 20), None, "b"), (201, None, None, None)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(documents(spark, rows), min_docs=50, max_share=0.02).collect()}
    assert all(got[i].kept and got[i].removed_words == 80 for i in range(30))
    assert not any(got[100 + i].kept for i in range(30)) and not got[100].base_failed
    assert got[200].kept and got[200].removed_words == 0  # another host
    assert (got[201].n_words, got[201].base_failed, got[201].kept) == (0, True, False)
    clean = {r.doc_id: r.text for r in quality_rules.clean_text(documents(spark, rows), min_docs=50).collect()}
    assert shared not in clean[0] and shared in clean[200] and clean[201] is None


def test_shared_lines_go_at_hosts_of_every_size(spark):
    rng = random.Random(31)
    shared, rows = words(rng, 80), []
    for host, n, holders in (("small", 20, 8), ("large", 600, 8), ("few", 20, 3)):  # 8 documents are under 2 % of 600
        rows += [(len(rows) + i, (shared + "\n" if i < holders else "") + words(rng, 60), None, host) for i in range(n)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(documents(spark, rows)).collect()}
    for i, text, _, host in rows:
        depleted = shared in text and host != "few"
        assert (got[i].removed_words, got[i].kept, got[i].base_failed) == (80 if depleted else 0, not depleted, False)


def brute_verdicts(rows, min_docs, max_share, min_left):
    """doc_id, removed words and verdict of each row (doc_id, text, lang, host), by dictionaries."""

    def lines(text):
        made = [re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ") for x in (text or "").split("\n")]
        return [x for x in made if x]

    holders, of_host = {}, {}
    for i, text, _, host in rows:
        own = i if i is not None else ("no id", text)
        of_host.setdefault(host, set()).add(own)
        for x in lines(text):
            holders.setdefault((host, x), set()).add(own)
    out = []
    for i, text, _, host in rows:
        n, *_, repeated = quality_rules.text_counts(text)
        gone = sum(len(x.split(" ")) for x in lines(text) if len(holders[host, x]) > max(min_docs, max_share * len(of_host[host])))
        out.append((i, gone, not (n < 50 or 100 * repeated > 50 * n) and n - gone >= min_left * n))
    return sorted(out, key=str)


@pytest.mark.parametrize(("min_docs", "max_share"), [(3, 0.0), (1, 0.1)])
def test_verdicts_equal_brute_force(spark, min_docs, max_share):
    rng = random.Random(32)
    pool = [words(rng, rng.choice([5, 20, 40])) + rng.choice(["", " 12", " 77"]) for _ in range(12)]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.sample(pool, rng.randint(0, 3)) + [words(rng, rng.choice([0, 30, 60]))] * rng.choice([1, 1, 2])), None, rng.choice(["a", "b", None])) for _ in range(150)]
    shared = words(rng, 60)
    rows += [(900, shared, None, "c")] * 60 + [(901, shared + "\n" + words(rng, 50), None, "c")] + [(None, None, None, None), (None, "", None, "a")] * 5
    got = sorted(((r.doc_id, r.removed_words, r.kept) for r in quality_rules.apply_rules(documents(spark, rows), min_docs=min_docs, max_share=max_share).collect()), key=str)
    assert got == brute_verdicts(rows, min_docs, max_share, 0.5)
    if not max_share:  # a line of one document in 60 rows is in one document
        assert (900, 0, True) in got


def test_rules_on_odd_rows(spark):
    docs = documents(spark, ODD)
    assert quality_rules.apply_rules(docs).count() == len(ODD)
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


# 3


def check_packing(pieces, docs, length=1024):
    t = Tokenizer.from_file(VOCABULARY)
    want = sorted(tuple(e.ids) + (0,) for e in t.encode_batch([x or "" for _, x, *_ in docs], add_special_tokens=False))
    by_sequence: dict = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    sizes = []
    for k in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[k], key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        sizes.append(at)
    assert all(s == length for s in sizes[:-1]) and sum(sizes) == sum(map(len, want))
    assert sorted(by_sequence) == list(range(len(sizes)))
    return want


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 400)), None, f"s{i % 3}") for i in range(120)] + [(900, LONG, None, "s0"), (901, None), (902, "<|endoftext|> a")]
    got = packing.pack_documents(documents(spark, rows), VOCABULARY).collect()
    check_packing(got, rows)
    t = Tokenizer.from_file(VOCABULARY)
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((p for p in got if p.doc_id == i), key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and own[-1].start + own[-1].length == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids) for p in own)


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 1.0}])
def test_windows_hold_the_target_mixture(spark, weights):
    rng = random.Random(5)
    rows = [(i, words(rng, 300), None, "s0" if i % 2 else "s1") for i in range(200)]
    tokens = packing.tokenise(documents(spark, rows), VOCABULARY).cache()
    got = packing.pack(tokens, 64, 16, weights, unit=1).collect()
    check_packing(got, rows, 64)
    source = {i: s for i, _, _, s in rows}
    share: dict = {}
    for p in got:
        share.setdefault(p.sequence_id // 16, {"s0": 0, "s1": 0})[source[p.doc_id]] += p.length
    total = {s: sum(w[s] for w in share.values()) for s in ("s0", "s1")}
    want = 0.75 if weights else total["s0"] / sum(total.values())
    full = [w for k, w in sorted(share.items())][: int(total["s0"] / 0.75 / 1024) - 1 if weights else -1]
    assert full and all(abs(w["s0"] - want * 1024) <= 2 for w in full)


class Node:
    """A node of the tree of queues, simulated: its sides' deficits grow by their shares, whole units are sent, the rest is carried."""

    def __init__(self, leaves, lo, hi, path=()):
        self.units, self.parts, self.deficit = sum(leaves[lo:hi]), [], Fraction(0)
        self.sent = []
        if hi - lo == 1:
            self.leaf, self.path = lo, list(path)
        else:
            size = 1 << (hi - lo - 1).bit_length() - 1
            left, both = sum(leaves[lo : lo + size]), self.units
            split = left and left < both
            self.parts = [Node(leaves, lo, lo + size, [*path, (False, left, both)] if split else path), Node(leaves, lo + size, hi, [*path, (True, left, both)] if split else path)]

    def send(self, units):
        self.sent.append(units)
        if self.parts:
            left, right = self.parts
            if not left.units or not right.units:
                now = units if left.units else 0
            else:
                self.deficit += Fraction(units * left.units, self.units)
                now = int(self.deficit)
                self.deficit -= now
            left.send(now)
            right.send(units - now)

    def all(self):
        return [x for p in self.parts for x in p.all()] if self.parts else [self]


@pytest.mark.parametrize("unit", [1, 8, 64])
def test_closed_form_is_the_round_robin(unit):
    rng = random.Random(51 + unit)
    for _ in range(12):
        sizes, window = [rng.choice([0, 1, 7, 300, rng.randint(1, 9000)]) for _ in range(rng.randint(1, 9))], 512 // unit
        units = [n // unit for n in sizes]
        root, whole = Node(units, 0, len(units)), sum(units)
        for w in range(-(-whole // window)):
            root.send(min(window, whole - w * window))
        (plan,) = packing.turns([whole], [0.0])
        filled, tail = [], whole * unit
        for leaf in root.all():
            n = sizes[leaf.leaf]
            queue = packing.Queue(plan, leaf.path, units[leaf.leaf], tail, window, unit)
            got, at = [0] * len(leaf.sent), 0
            while at < n:  # documents of any length
                k = min(n - at, rng.choice([1, 3, 50, 5000]))
                pieces = queue.pieces(at, k)
                assert [p[1] for p in pieces] == [0, *np.cumsum([p[2] for p in pieces])[:-1]] and sum(p[2] for p in pieces) == k
                for place, _, m in pieces:
                    if place < whole * unit:
                        got[place // unit // window] += m
                    filled += range(place, place + m)
                at += k
            assert got == [unit * x for x in leaf.sent]
            tail += n % unit
            for w in range(len(leaf.sent)):  # never far from its share
                assert abs(sum(leaf.sent[: w + 1]) - min((w + 1) * window, whole) * leaf.units / max(whole, 1)) <= 1 + len(leaf.path)
        assert sorted(filled) == list(range(sum(sizes)))


def test_phases_of_weights_fill_every_place():
    rng = random.Random(53)
    for _ in range(30):
        sizes, weights = [rng.randint(0, 400) for _ in range(4)], [rng.choice([0, 1, 2.5, 7]) for _ in range(4)]
        plan, filled, tail = packing.turns([n // 8 for n in sizes], weights), [], 8 * sum(n // 8 for n in sizes)
        for c, n in enumerate(sizes):
            filled += [x for place, _, m in packing.Queue(plan[c], [], n // 8, tail, 16, 8).pieces(0, n) for x in range(place, place + m)]
            tail += n % 8
        assert sorted(filled) == list(range(sum(sizes)))


def test_every_source_has_its_own_share(spark):
    rng = random.Random(52)
    rows = [(i, words(rng, 30), None, ["big", "big", "big", "mid", None][i % 5] if i % 100 else f"tiny{i}") for i in range(1500)]
    tokens = packing.tokenise(documents(spark, rows), VOCABULARY).cache()
    source = {i: s for i, _, _, s in rows}
    for weights, order in ((None, None), ({"mid": 3.0, "tiny100": 1.0, "big": 0.0, "nowhere": 2.0}, ["mid", "tiny100"])):
        got = packing.pack(tokens, 64, 16, weights, unit=16, block=2000).collect()
        check_packing(got, rows, 64)
        total, by = Counter(), {}
        for p in got:
            total[source[p.doc_id]] += p.length
            by.setdefault(p.sequence_id // 16, Counter())[source[p.doc_id]] += p.length
        if weights is None:
            assert all(abs(w[s] - 1024 * total[s] / sum(total.values())) <= 16 * 2 * 5 for k, w in by.items() if k < max(by) - 1 for s in total)  # two units for each of five levels
        else:
            first = by[0]  # mid and tiny100 go first, 3 to 1, until one is empty; the others wait for both
            assert set(first) >= set(order) and first["mid"] >= total["tiny100"] and total["big"] == sum(w["big"] for k, w in by.items() if k >= total["mid"] // 1024)
    with pytest.raises(ValueError):
        packing.pack(tokens, weights={"big": -1.0})


def test_repeated_rows_are_dealt_over_blocks(spark):
    rows = [(None, "the same text", None, "s")] * 3000
    tokens = packing.tokenise(documents(spark, rows), VOCABULARY)
    assert tokens.select("copy").distinct().count() > 50
    check_packing(packing.pack(tokens, 64, 16, block=500).collect(), rows, 64)


def test_packing_odd_rows(spark):
    docs = documents(spark, ODD)
    check_packing(packing.pack_documents(docs, VOCABULARY).collect(), ODD)
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_packing_ids_are_those_of_the_tokenizer_file(tmp_path):
    around = [f"a{c}1{c}{c} {c}b {c}  .{c}" for k in range(0, 0x110000, 61) if not 0xD800 <= k < 0xE000 for c in [chr(k)]]
    texts = [*around, "", " ", "\n\n a", "it's 's'll\r\n \t x", "<|endoftext|> a<|endoftext|>", "a" * 30_000, " " * 30_000, "1" * 1999, "ab" * 999, "x " * 5000]
    library = Tokenizer.from_file(VOCABULARY)
    expected = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    made = packing.Encoder(VOCABULARY)
    assert made.fast is not None and made.plain("a b") and not made.plain("a" * 5000)
    assert made.of(texts) == expected
    # A file that puts a space in front of each text is left to the library.
    other = json.loads(library.to_str())
    other["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(other))
    prefixed = packing.Encoder(str(tmp_path / "other.json"))
    assert prefixed.fast is None
    assert prefixed.of(["ab c"]) == [np.array(library.encode(" ab c").ids, "<u2").tobytes()]


# 4 and 8


def labelled(spark, make, n=240, **columns):
    rng = random.Random(6)
    rows = [(i, make(rng, i % 4 == 0), None, None) for i in range(n)]
    name = next(iter(columns))
    labels = spark.createDataFrame([(i, int((i % 4 == 0) == columns[name]), "x") for i in range(n)] + [(None, 1, "x"), (5, None, "x")], f"doc_id long, {name} int, text string")
    return documents(spark, rows), labels


def test_repeated_neighbours_of_any_length(spark):
    texts = [None, "", " ", "a", "a a", "a b a", "a a a b b", " a\ta  b ", "b " * 20_000, " ".join(f"w{k // 2}" for k in range(20_000))]
    docs = documents(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    got = {r.doc_id: r.repeats for r in docs.select("doc_id", rule_ensemble.statistics(F.col("text"))["repeats"].alias("repeats")).collect()}
    for k, t in enumerate(texts):
        words = (t or "").split()
        assert got[k] == sum(a == b for a, b in itertools.pairwise(words)) / max(1, len(words))


def test_rules_find_what_marks_quality(spark):
    docs, labels = labelled(spark, lambda rng, bad: words(rng, 60).upper() if bad else words(rng, 60), quality=False)
    model = rule_ensemble.train(docs, labels, "quality", F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r.score for r in rule_ensemble.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == (i % 4 != 0) for i in range(240))
    assert len(model.rules) < 60 and all(len(c) <= 3 for c, _ in model.rules)
    odd = rule_ensemble.score(documents(spark, ODD), model, ["doc_id", "score"]).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and len(r) == 2 for r in odd)  # the operator's own score
    constant = rule_ensemble.train(docs, labels.limit(0), "quality", F.lit(True))
    assert {r.score for r in rule_ensemble.score(documents(spark, ODD), constant, ["doc_id"]).collect()} == {0.5}


def brute_statistics(text):
    """The statistics by plain Python."""
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x.strip(" ") for x in t.split("\n") if x.strip(" ")]
    n, of_words = max(len(t), 1), max(len(words), 1)
    share = lambda chars: sum(c in chars for c in t) / n
    kind = lambda k: (n - len([c for c in t if not unicodedata.category(c).startswith(k)])) / n
    return {
        "chars": len(t), "words": len(words), "word_length": sum(map(len, words)) / of_words, "symbols": share(rule_ensemble.SYMBOLS), "marks": share("!"), "bars": share("|"),
        "punctuation": share(rule_ensemble.PUNCTUATION), "digits": share("0123456789"), "upper": kind("Lu"), "letters": kind("L"), "distinct_words": len(set(words)) / of_words,
        "repeats": sum(a == b for a, b in itertools.pairwise(words)) / of_words, "lines": len(lines) / of_words, "distinct_lines": len(set(lines)) / max(len(lines), 1), "longest_word": max(map(len, words), default=0),
    }


def test_statistics_and_compiled_rules_equal_brute_force(spark):
    rng = random.Random(41)
    texts = [None, "", " ", "\n\n", "A", *["".join(rng.choice("aB é|!#.,1\n\t 🙂ß") for _ in range(rng.randint(1, 200))) for _ in range(60)], "w " * 3000]
    docs = documents(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    stats = rule_ensemble.statistics(F.col("text"))
    got = {r.doc_id: r for r in docs.select("doc_id", *[c.alias(n) for n, c in stats.items()]).collect()}
    names, x = list(stats), []
    for k, t in enumerate(texts):
        want = brute_statistics(t)
        x.append([want[n] for n in names])
        for n in names:
            # An empty text counts a letter's place: (1 - 0) / 1.
            assert got[k][n] == pytest.approx(want[n]), (n, t)
    x = np.array(x, float)
    rules = [tuple((names[j], bool(rng.getrandbits(1)), float(rng.choice(x[:, j]))) for j in rng.sample(range(len(names)), rng.randint(1, 3))) for _ in range(40)]
    model = rule_ensemble.RuleModel(-0.3, [(r, rng.uniform(-2, 2)) for r in rules])
    total = -0.3 + rule_ensemble.holds(x, names, rules) @ np.array([w for _, w in model.rules])
    scored = {r.doc_id: r.score for r in rule_ensemble.score(docs, model, ["doc_id"]).collect()}
    assert all(scored[k] == pytest.approx(1 / (1 + math.exp(-total[k]))) for k in range(len(texts)))


def test_tree_paths_are_rules_and_leaves_part_the_rows():
    rng = np.random.default_rng(5)
    x = rng.random((400, 3))
    y = (x[:, 0] > 0.5) & (x[:, 1] <= 0.4)
    rules, leaves = rule_ensemble.grow(x, ["a", "b", "c"], y - y.mean(), [np.linspace(0.05, 0.95, 19)] * 3, 3, 5)
    z = rule_ensemble.holds(x, ["a", "b", "c"], [r for r, leaf in zip(rules, leaves, strict=True) if leaf])
    assert (z.sum(axis=1) == 1).all() and any(len(r) < 3 for r, leaf in zip(rules, leaves, strict=True) if leaf)


def test_samples_are_bounded_where_ids_repeat(spark):
    docs = documents(spark, [(1, "same text here", "aa", None)] * 500 + [(2, "other text there", "bb", None)] * 3)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    whole = rule_ensemble.fit
    try:
        rule_ensemble.fit = lambda x, y, names, **k: seen.append(len(x)) or whole(x, y, names, **k)
        rule_ensemble.train(docs, labels, "quality", F.lit(True), most=50)
    finally:
        rule_ensemble.fit = whole
    assert seen == [50]
    model = language_id.train(docs, F.lit(True), per_language=20)
    assert model.languages == ["aa", "bb"]


def test_lasso_drops_useless_columns():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (400, 6)).astype(float)
    w, _ = rule_ensemble.lasso_logistic(z, z[:, 2], 0.01)
    assert w[2] > 1 and np.abs(np.delete(w, 2)).max() < 0.2


def test_toxic_words_are_found_and_clean_texts_left(spark):
    def make(rng, bad):
        text = words(rng, 120).split()
        if bad:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["zzqux", "zzquxes", "vokkerl"]))
        return " ".join(text)

    docs, labels = labelled(spark, make, 400, toxic=True)
    model = toxicity.train(docs, labels, "toxic", F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    odd = toxicity.score(documents(spark, ODD), model, ["doc_id"]).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0), "toxic", F.lit(True)), ["doc_id"]).count() == 0


def test_kneser_ney_probabilities_sum_to_one():
    counts: dict = {}
    for w in ("abab", "abba", "bab", "caab", "acb"):
        for g in toxicity.grams(w):
            o, t = counts.get(g, (0, 0))
            counts[g] = (o + 1, t + (w == "bab"))
    m = toxicity.KneserNey(counts)
    characters = [*m.lower[1], "?"]  # and one that was never seen
    for context in {g[:-1] for g in counts}:
        shared = {c: m.shared(context + c) for c in characters}
        assert sum(shared.values()) == pytest.approx(1, abs=1e-9)
        seen, toxic, freed, freed_toxic = m.total[context]
        for k, all_, rest in ((0, seen, freed), (1, toxic, freed_toxic)):
            if all_:
                of = {c: (max(counts.get(context + c, (0, 0))[k] - m.own, 0) + rest * p) / all_ for c, p in shared.items()}
                assert sum(of.values()) == pytest.approx(1, abs=1e-9)


def test_gram_ratio_by_hand():
    """P(b | aaa) of both classes, from counts small enough to work out."""
    counts = {"aaab": (1, 2), "aaac": (3, 0)}
    m, d, own = toxicity.KneserNey(counts), toxicity.DISCOUNT, toxicity.OWN
    one = (1 - d) / 2 + d * 2 / 2 / 3  # one of two types, backing off to one of two characters or an unseen one
    two = three = lambda lower: (1 - d) / 2 + d * 2 / 2 * lower
    shared = (3 - d) / 6 + d * 2 / 6 * three(two(one))
    ordinary, toxic = (1 - own + 2 * own * shared) / 4, (2 - own + own * shared) / 2
    assert m.shared("aaab") == pytest.approx(shared) and m.gram_ratio("aaab") == pytest.approx(math.log(toxic / ordinary))


def test_ratios_come_from_every_row_as_in_one_dictionary(spark, monkeypatch):
    rng = random.Random(81)
    rows = [(i, words(rng, 40) + (" zzqux vokkerl" if i % 4 == 0 else ""), None, None) for i in range(300)] + [(900, None), (None, "nobody knows"), (901, "ab" * 300 + "zzqux" + "cd" * 300)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "toxic", F.lit(True), most=20)
    calibration = {r.doc_id for r in labels.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()}
    counts, every = {}, {}
    for i, text, *_ in rows:
        for w in toxicity.WORD.findall((text or "").lower()):
            for g in toxicity.grams(w):
                every[g] = every.get(g, 0) + 1
                if i is not None and i < 200 and i not in calibration:
                    o, t = counts.get(g, (0, 0))
                    counts[g] = (o + (i % 4 != 0), t + (i % 4 == 0))
    whole = toxicity.KneserNey(counts, every)
    for g in every:
        assert model.known.get(g, model.known.get(g[:-1], 0.0)) == pytest.approx(whole.gram_ratio(g), abs=1e-9)
    assert whole.gram_ratio("zzqu") > 0 and len(calibration) == 20
    # A table too large to broadcast gives the same by joins, copies and odd rows included.
    again = documents(spark, [*rows, *rows[:3], *ODD])
    here = toxicity.measured(again, model, ["doc_id", "key"]).collect()
    monkeypatch.setattr(toxicity, "MOST_RATIOS", 10)
    monkeypatch.setattr(toxicity, "MOST_LABELS", 10)
    large = toxicity.train(docs, labels, "toxic", F.lit(True), most=20)
    joined = toxicity.measured(again, large, ["doc_id", "key"]).collect()
    assert large.known is None and (large.weight, large.intercept) == pytest.approx((model.weight, model.intercept))
    for a, b in zip(*(sorted(((-1 if r.doc_id is None else r.doc_id), *(r[c] for c in toxicity.FEATURES)) for r in x) for x in (here, joined)), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_long_runs_are_counted_and_scored_whole():
    run = "ab" * 300 + "zzqux" + "cd" * 300
    found, slices = toxicity.words_of(f"one {run} two")
    assert found == ["one", "two"] and [g for s in slices for g in toxicity.windows(s)] == toxicity.grams(run)
    assert "zzqu" in toxicity.grams(run)
    known = {"zzqu": 9.0, "abab": -0.5}
    toxic, ordinary, both = toxicity.features(run, toxicity.Words(known))
    assert toxic * (len(slices) + toxicity.NEUTRAL) == pytest.approx(9.0 - toxicity.MARGIN)
    assert ordinary < 0 and both == pytest.approx(max(toxic + ordinary, 0))  # what the ordinary model explains better speaks against it


TOXIC = ["zzqux", "vokkerl", "wuzzgat", "jyffed", "qwozzle", "xarvunk", "yibbok", "zhuvvy", "kwezzit", "vuxxor"]


def brute_score(model, text):
    """The score of a text by the ratios of its words, in plain Python."""
    total, n = 0.0, 0
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        ratio, padded = 0.0, "^^^" + w + "$"
        for k in range(len(w) + 1):
            ratio += model.known.get(padded[k : k + 4], model.known.get(padded[k : k + 3], 0.0))
        n += 1
        total += min(ratio - 2.5, 12) if ratio > 2.5 else 0.1 * max(ratio + 2.5, -12) if ratio < -2.5 else 0
    mean = min(max(total / (n + 240), 0), 0.1)
    return 1 / (1 + math.exp(-model.intercept - model.weight * math.log(1 + 100 * mean)))


def test_scores_rise_with_toxic_words_and_fall_with_ordinary_ones(spark):
    def make(rng, bad):
        text = words(rng, 120).split()
        for _ in range(bad and rng.randint(1, 6)):
            text.insert(rng.randrange(len(text)), rng.choice(TOXIC))
        return " ".join(text)

    docs, labels = labelled(spark, make, 400, toxic=True)
    model = toxicity.train(docs, labels, "toxic", F.lit(True))
    rng = random.Random(5)
    plain = words(rng, 60)
    texts = {"none": "", "plain": plain, "one": TOXIC[0], "ten": " ".join(TOXIC), "repeated": " ".join([TOXIC[0]] * 40), "hundreds": " ".join(TOXIC * 40)}
    texts |= {f"plain and {k}": f"{plain} {' '.join((TOXIC * 3)[:k])}" for k in (1, 3, 10, 30)}
    texts |= {f"ten in {k}": f"{' '.join(TOXIC)} {words(rng, k)}" for k in (50, 200, 1000, 20_000)}
    got = {r.key: r.score for r in toxicity.score(spark.createDataFrame(list(texts.items()), "key string, text string"), model, ["key"]).collect()}
    for k, t in texts.items():
        assert got[k] == pytest.approx(brute_score(model, t), abs=1e-9), k
    assert all(got[k] >= 0.7 for k in ("one", "ten", "repeated", "hundreds", "plain and 3", "plain and 10", "plain and 30", "ten in 50"))
    assert max(got["none"], got["plain"]) < 0.3
    cache = toxicity.Words(model.known)
    most = [w for w in TOXIC if cache[w] >= toxicity.MOST_MEAN]
    least = [w for w in words(rng, 300).split() if cache[w] <= 0]
    assert len(most) == len(TOXIC) and len(least) > 100
    for start in ([], plain.split(), most, most * 30, [*plain.split(), *most]):
        text, last = list(start), toxicity.features(" ".join(start), cache)[-1]
        for _ in range(60):
            text.insert(rng.randrange(len(text) + 1), rng.choice(most))
            now = toxicity.features(" ".join(text), cache)[-1]
            assert now >= last
            last = now
        for _ in range(60):
            text.insert(rng.randrange(len(text) + 1), rng.choice(least))
            now = toxicity.features(" ".join(text), cache)[-1]
            assert now <= last + 1e-15
            last = now


def test_columns_with_the_names_of_features(spark):
    model = toxicity.Model(spark.createDataFrame([], "gram string, ratio double"), {"zzqu": 9.0})
    docs = documents(spark, ODD).withColumns({c: F.lit(5.0) for c in toxicity.FEATURES})
    got = toxicity.score(docs, model, ["doc_id", "score", "mean", "text", "n_chars"])
    assert got.columns == ["doc_id", "text", "n_chars", "score", *toxicity.FEATURES] and got.where("mean = 5 or n_chars <> 7").isEmpty()


# 5


def test_languages_are_told_apart(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, 50, "abcde" if i % 2 else "vwxyzé"), "aa" if i % 2 else "bb") for i in range(120)] + [(500, "12 34 !", "aa"), (501, None, "bb"), (502, "abc", None)]
    docs = documents(spark, rows)
    model = language_id.train(docs, F.col("doc_id") % 3 != 0, per_language=30, centroids=2)
    got = {r.doc_id: r for r in language_id.identify(docs, model, ["doc_id"], reject=False).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") and 0 <= got[i].score <= 1 for i in range(120))
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "aa"
    far = documents(spark, [(1, "ЖЖЖ ЩЩЩ ЮЮЮ")])
    assert language_id.identify(far, model, ["doc_id"]).first().lang_pred == "und"
    assert language_id.identify(documents(spark, ODD), model, ["doc_id"], reject=False).count() == len(ODD)
    nothing = language_id.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_nearest_centroid_equals_brute_force(spark):
    rng = random.Random(71)
    rows = [(i, words(rng, rng.randint(1, 60), ["abcde", "cdefg", "xyzé"][i % 3]), ["aa", "bb", "cc"][i % 3]) for i in range(150)]
    docs = documents(spark, rows)
    model = language_id.train(docs, F.col("doc_id") < 90, per_language=30, centroids=3)
    got = {r.doc_id: r for r in language_id.identify(docs, model, ["doc_id", "score", "lang"], reject=False).collect()}
    for i, text, *_ in rows:
        raw = b" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode() + b" "
        counts = Counter()
        for at in range(len(raw)):  # n-grams of one, two and three bytes, with 32-bit arithmetic
            counts[raw[at]] += 1
            if at + 1 < len(raw):
                counts[((raw[at] * 257 + raw[at + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
            if at + 2 < len(raw):
                h = ((raw[at] * 257 + raw[at + 1]) * 0x85EBCA77 + raw[at + 2] * 0xC2B2AE3D) & 0xFFFFFFFF
                counts[((h ^ h >> 15) * 0x27D4EB2F & 0xFFFFFFFF) >> 20] += 1
        vector = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosine = [sum(v * float(c[k]) for k, v in vector.items()) / norm for c in model.centroids]
        best = [max(x for x, o in zip(cosine, model.owner, strict=True) if o == k) for k in range(3)]
        assert got[i].lang_pred == model.languages[int(np.argmax(best))]
        assert got[i].score == pytest.approx(1 / sum(math.exp(20 * (x - max(best))) for x in best), rel=1e-3)
        assert got[i].lang == ["aa", "bb", "cc"][i % 3] and len(got[i]) == 5


def test_letterless_rows_do_not_push_a_language_out(spark):
    rng = random.Random(72)
    rows = [(i, f"{i} 123 !", "aa") for i in range(20_000)] + [(100_000 + i, words(rng, 20, "abcde"), "aa") for i in range(100)] + [(200_000 + i, words(rng, 20, "vwxyz"), "bb") for i in range(100)]
    model = language_id.train(documents(spark, rows), F.lit(True), per_language=40)
    assert model.languages == ["aa", "bb"]


def test_signs_and_junk_do_not_tell_a_language(spark):
    rng = random.Random(73)
    rows = [(i, words(rng, 30, "abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "bb") for i in range(200)]
    rows += [(1_000 + i, words(rng, 30, "abcde").upper().replace(" ", "!! "), "aa") for i in range(6)] + [(2_000 + i, "q##q q%%q " * 9, "bb") for i in range(4)]
    docs = documents(spark, rows)
    model = language_id.train(docs, F.lit(True), per_language=200)
    shouted = documents(spark, [(i, words(rng, 30, "abcde" if i % 2 else "vwxyz").upper().replace(" ", "$$ 12 ")) for i in range(60)])
    got = {r.doc_id: r.lang_pred for r in language_id.identify(shouted, model, ["doc_id"], reject=False).collect()}
    assert all(got[i] == ("aa" if i % 2 else "bb") for i in got)


def test_idf_vectors_are_unit_length():
    model = language_id.Model([], np.ones(language_id.DIM, np.float32), np.zeros((0, language_id.DIM)), np.zeros(0), np.zeros(0))
    x = model.vectors(np.stack([language_id.features("abc def"), language_id.features("")]))
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)


# 6


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(RANKS)


def test_byte_bpe_equals_tiktoken_and_round_trips(bpe):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["".join(rng.choice("aàb'sllre  \n\t\r　\x1c\x85 12٣!!<|>é한🙂") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in [*texts, "a" * 3000, "ab" * 1500 + " " * 1500, LONG[:20_000], "<|endoftext|>", ""]:
        ids = bpe.encode(t)
        assert ids == own.encode_ordinary(t), repr(t)[:80]
        assert bpe.decode(ids) == t.encode()


def test_long_rows_merge_as_short_ones(bpe):
    for p in (b"abcdefgh" * 40, b"hello" * 60, bytes(range(256)) * 3):
        assert bpe.encode_long(p) == bpe.encode_pieces([p])[0]


def test_bpe_digests_of_odd_rows(spark, bpe):
    got = byte_bpe.digests(documents(spark, ODD), RANKS).collect()
    want = sorted((len(ids := bpe.encode(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in ODD)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(documents(spark, ODD), RANKS), RANKS).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((t or "").encode() for _, t in ODD)
    assert byte_bpe.digests(documents(spark, []), RANKS).count() == 0


# 7

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False)}}


def messages(spark, rows):
    return spark.createDataFrame([(c, t, r, json.dumps(x) if isinstance(x, dict) else x, "x") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, level string")


def call(i, args, needs=(), name="add"):
    return {"id": i, "name": name, "arguments": json.dumps(args) if not isinstance(args, str) else args, "depends_on": list(needs)}


def test_calls_are_linked_ordered_and_validated(spark):
    m = messages(spark, [
        (1, 0, "user", "hi"), (1, 1, "assistant", {"tool_calls": [call("c", {"b": 2.5, "a": 1}, ["d"]), call("d", {"a": 2})]}), (1, 2, "tool", {"tool_call_id": "d", "content": "r"}),
        (1, 3, "tool", {"tool_call_id": "d", "content": "again"}), (1, 4, "tool", {"tool_call_id": "zz", "content": "?"}), (1, 5, "assistant", None), (1, 6, None, "{"),
        (2, 1, "assistant", {"tool_calls": [call("x", {"a": 1}, ["y"]), call("y", {"a": "no"}, ["x"]), call("w", "not json", ["x"]), call("u", {}, name="what")]}),
    ])
    made = tool_calls.serialised(tool_calls.ordered(tool_calls.link(tool_calls.calls_of_messages(m), tool_calls.results_of_messages(m))), SCHEMAS)
    got = {r.call_id: r for r in made.collect()}
    assert {k: r.status for k, r in got.items()} == {"c": "unanswered", "d": "linked", "zz": "orphan", "x": "unanswered", "y": "unanswered", "w": "unanswered", "u": "unanswered"}
    assert got["d"].level == 0 and got["c"].level == 1 and got["d"].n_results == 2 and got["d"].content == "r"
    assert got["x"].level is None and got["w"].level is None and got["u"].level == 0
    assert got["c"].valid and got["y"].violations == "not integer: a" and got["w"].violations == "arguments are no JSON" and "unknown tool" in got["u"].violations
    assert got["c"].record == '{"arguments":{"a":1,"b":2.5},"call_id":"c","depends_on":["d"],"level":1,"name":"add","status":"unanswered"}'


def brute_levels(needs):
    """needs: call -> set of calls; the longest way to each, None on or behind a cycle."""
    known, changed = {}, True
    while changed:
        changed = False
        for x, of in needs.items():
            if x not in known and all(y in known for y in of):
                known[x], changed = max((known[y] + 1 for y in of), default=0), True
    return {x: known.get(x) for x in needs}


@pytest.mark.parametrize("seed, most", [(0, 200_000), (1, 200_000), (2, 200_000), (0, 3), (1, 0)])
def test_levels_are_the_longest_way_of_needs(spark, monkeypatch, seed, most):
    monkeypatch.setattr(tool_calls, "MOST_NEEDS", most)
    rng, rows, want = random.Random(70 + seed), [], {}
    for conv in range(6):
        names = [f"k{j}" for j in range(rng.choice([1, 5, 40]))]
        needs = {}
        for j, x in enumerate(names):  # mostly chains, back and forth in turns, with joints and, in some, a cycle
            pool = names[:j] if conv % 2 else names[j + 1 :]
            own = {rng.choice(pool)} if pool and rng.random() < 0.5 else set(pool[-1:] if conv % 2 else pool[:1])
            if pool and rng.random() < 0.2:
                own |= set(rng.sample(pool, min(3, len(pool))))
            needs[x] = own
        if conv == 5 and len(names) > 4:
            needs["k1"], needs["k3"] = {"k3"}, {"k1"}
        rows += [(conv, j, x, "add", '{"a":1}', [*sorted(needs[x]), "elsewhere", *list(needs[x])[:1]], "mine") for j, x in enumerate(names)]
        want |= {(conv, x): v for x, v in brute_levels(needs).items()}
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, level string")
    results = spark.createDataFrame([(1, 9, "nobody", "c")], "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r.level for r in tool_calls.ordered(tool_calls.link(calls, results)).collect()}
    assert got.pop((1, "nobody")) is None and got == want


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, write = [], tool_calls.materialise
    monkeypatch.setattr(tool_calls, "materialise", lambda df, label: rounds.append(label) or write(df, label))
    calls = spark.range(300).selectExpr("1L conv_id", "id turn", "string(id) call_id", "'add' name", "'{}' arguments", "array(string(id - 1)) depends_on")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = {int(r.call_id): r.level for r in tool_calls.ordered(tool_calls.link(calls, results)).collect()}
    assert got == {k: k for k in range(300)} and rounds.count("chains") <= 10


def test_long_ladders_of_two_needs_take_few_rounds(spark, monkeypatch):
    rounds, write = [], tool_calls.materialise
    monkeypatch.setattr(tool_calls, "materialise", lambda df, label: rounds.append(label) or write(df, label))
    m = spark.range(400).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "'some text' text")
    got = {r.call_id: r.level for r in tool_calls.ordered(tool_calls.link(*tool_calls.turns_as_calls(m))).collect()}
    ids = [t for t in range(0, 400, 2) if t % 10 != 6]
    assert got == {f"1:{t}": k for k, t in enumerate(ids)} and len(rounds) <= 14


def test_limits_of_arguments(spark):
    limits = {"add": {"s": ("string", False, {"min_length": 2, "max_length": 3, "enum": ["ab", "abc"]}), "n": ("number", False, {"minimum": 0, "maximum": 1.5})}}
    cases = {'{"s":"ab","n":1.5}': "", '{"s":"a"}': "too short: s; not allowed: s", '{"s":"abcd"}': "too long: s; not allowed: s", '{"n":-1}': "too small: n", '{"n":2,"s":null}': "too large: n", '{"s":1}': "not string: s"}
    frame = spark.createDataFrame(list(cases.items()), "a string, want string")
    got = frame.select("a", "want", F.array_join(tool_calls.violations(F.lit("add"), F.try_parse_json("a"), limits), "; ").alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_plain_conversations_and_empty_tables(spark):
    m = messages(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", None), (None, 0, "user", "x"), (2, 5, "assistant", "late"), (1, 0, "user", "q")])
    linked = tool_calls.link(*tool_calls.turns_as_calls(m))
    got = {r.call_id: r for r in linked.collect()}
    assert {k: (r.status, r.n_calls) for k, r in got.items()} == {"1:0": ("linked", 2), "1:2": ("unanswered", 1), "2:4": ("orphan", 0)}
    assert tool_calls.ordered(tool_calls.link(*tool_calls.turns_as_calls(m.limit(0)))).count() == 0


# 9


def brute_components(rows, k, pct):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= pct * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(rng):
    rows, n = [], 0
    for _ in range(12):
        base = words(rng, rng.choice([1, 3, 30, 90, 200])).split()
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = words(rng, 1)
            rows.append((n, " ".join(own)))
            n += 1
    base = words(rng, 150).split()
    for _ in range(90):  # a family over the limit of small regions
        own = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            own[rng.randrange(len(own))] = words(rng, 1)
        rows.append((n, " ".join(own)))
        n += 1
    shared = words(rng, 60)
    rows += [(n + i, shared + " " + words(rng, 150)) for i in range(60)]
    return rows


@pytest.mark.parametrize(("k", "pct"), [(4, 85), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, k, pct):
    rows = near_copies(random.Random(9 + k)) + [(5000, None), (5001, ""), (5002, "One two"), (5003, "oNE\ttwo"), (5004, LONG), (5005, LONG + " end")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(documents(spark, rows), k, pct).collect()}
    assert got == brute_components(rows, k, pct)
    assert got[5003][1] == 5002 and got[5005][1] == 5004


def test_large_regions_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(91)
    rows = [(k, n, n // 5, rng.choice([3, 3, 3, k]), b"", []) for k in range(200) for n in [rng.randint(60, 140)]]
    dealt = spark.createDataFrame([(t, *r) for t in (1, 2) for r in rows[: 200 if t == 1 else 6]], "token long, v long, n long, pos int, component long, sketch binary, earlier array<long>")
    made: dict = {}
    for r in jaccard_join.in_blocks(dealt, 85).collect():
        made.setdefault(r.part, []).append(r)
    met = {tuple(sorted((x.v, y.v))) for part in made.values() for x, y in itertools.combinations(part, 2) if x.side == 2 or x.side != y.side}
    want = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[3] != y[3] and 100 * min(x[1], y[1]) >= 85 * max(x[1], y[1])}
    assert want <= met and max(map(len, made.values())) < 40
    texts = near_copies(random.Random(17))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(documents(spark, texts), 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


def test_jaccard_join_odd_rows(spark):
    got = jaccard_join.join(documents(spark, ODD)).collect()
    assert len(got) == len(ODD) and sorted(r.component_id for r in got if r.doc_id is not None) == [1, 2, 3, 4, 4, 4, 6, 7, 2**60]
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard_join.join(documents(spark, [])).count() == 0


def test_copies_of_one_of_several_texts_of_an_id(spark):
    rng = random.Random(92)
    a, b, c = (words(rng, n) for n in (40, 60, 90))
    rows = [(3, a), (5, a), (5, b), (9, b), (9, c), (11, c), (12, c + " end"), (20, a), (20, ""), (30, words(rng, 50))]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(documents(spark, rows)).collect()]
    want = {3: 37, 5: 57, 9: 87, 11: 87, 12: 88, 20: 37}
    assert sorted(got) == sorted((i, want.get(i, 47), 3 if i in want else 30) for i, _ in rows)


def test_components_of_long_paths(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (601, 600), (600, 601)], "a long, b long")
    got = {r.v: r.component for r in jaccard_join.components(e).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 600: 600, 601: 600}


# 10


def test_digests_tell_edits_from_other_texts(spark):
    rng = random.Random(10)
    rows = [(i * 3, words(rng, rng.randint(40, 400))) for i in range(60)]
    got = sorted(fingerprints.compare_with_next(documents(spark, rows).repartition(5)).collect(), key=lambda r: r.doc_id)
    assert len(got) == 60
    for k, r in enumerate(got):
        text, after = rows[k][1], rows[(k + 1) % 60][1]
        new = fingerprints.edited(text, after)
        assert new == text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprints.fingerprint(text))
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint) > r.near_next == fingerprints.likeness(r.fingerprint, got[(k + 1) % 60].fingerprint)
    assert fingerprints.likeness(got[0].fingerprint, got[0].fingerprint) == 1


def brute_digest(text):
    """The digest byte by byte: a triplet is the window's last byte and two older ones."""
    raw, counts = (text or "").encode(), [0] * 256
    for at in range(len(raw)):
        byte = lambda back: raw[at - back] if at >= back else 0  # noqa: B023, E731
        for salt, (i, j) in enumerate(fingerprints.TRIPLETS):
            h = (byte(0) * 0x9E3779B1 + byte(i) * 0x85EBCA77 + byte(j) * 0xC2B2AE3D + salt * 0x27D4EB2F) & 0xFFFFFFFF
            counts[((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 24] += 1
    q1, q2, q3 = (sorted(counts)[256 * k // 4 - 1] for k in (1, 2, 3))
    codes = [sum(c > q for q in (q1, q2, q3)) for c in counts]
    ratios = [15 * q // q3 if q3 else 0 for q in (q1, q2)]
    head = [min(255, round(math.log(len(raw) + 1, 1.5))), 16 * ratios[0] + ratios[1]]
    return head, codes


@pytest.mark.parametrize("seed", range(4))
def test_digest_and_likeness_equal_brute_force(seed):
    rng = random.Random(100 + seed)
    texts = [None, "", "a", "\x00\x00", *[words(rng, n, "abcdeé🙂") for n in (1, 3, 40, 400)]]
    for a, b in itertools.product(texts, repeat=2):
        (x, p), (y, q) = brute_digest(a), brute_digest(b)
        packed = [p[4 * k] | p[4 * k + 1] << 2 | p[4 * k + 2] << 4 | p[4 * k + 3] << 6 for k in range(64)]
        assert fingerprints.fingerprint(a) == bytes(x + packed).hex()
        apart = 4 * abs(x[0] - y[0]) + abs(x[1] // 16 - y[1] // 16) + abs(x[1] % 16 - y[1] % 16)
        apart += sum(6 if abs(c - d) == 3 else abs(c - d) for c, d in zip(p, q, strict=True))
        assert fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) == pytest.approx(1 - min(apart, 416) / 416)


def test_digests_of_odd_rows(spark):
    got = fingerprints.compare_with_next(documents(spark, ODD)).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = sorted(hashlib.sha256(fingerprints.edited(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in got) == want
    alone = fingerprints.compare_with_next(documents(spark, [(1, "abcd efgh")])).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()
    assert fingerprints.compare_with_next(documents(spark, [])).count() == 0
    assert {r.fingerprint for r in fingerprints.fingerprints(documents(spark, [(1, "same"), (2, "same")])).collect()} == {fingerprints.fingerprint("same")}


def test_columns_with_the_names_of_steps_change_nothing(spark):
    """Columns that operators make on their way, as columns of the documents."""
    docs = documents(spark, [(i, words(random.Random(i), 30), "en", "s") for i in range(12)])
    named = docs.withColumns({c: F.lit("mine") for c in ("part", "edge", "q", "block", "u", "own", "at", "rank", "a", "l", "r", "word", "words_", "gram", "component_id", "fingerprint")})
    for run in (fingerprints.compare_with_next, lambda d: packing.pack_documents(d, VOCABULARY), lambda d: jaccard_join.join(d, k=4, pct=85), quality_rules.apply_rules):
        assert sorted(map(str, run(docs).collect())) == sorted(map(str, run(named).collect()))
