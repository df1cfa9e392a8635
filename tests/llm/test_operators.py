"""The operators against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402

from meshlight.llm import (  # noqa: E402
    components, extraction, licenses, lm, mixing, order_minhash, packing, quality, simhash, toxicity, url_filters,
)
from meshlight.llm import words as W  # noqa: E402
from meshlight.llm.queries import byte_bpe, remainder  # noqa: E402
from meshlight.session import written  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return written(cases.table(spark), "cases")


@pytest.fixture(scope="module")
def none(spark):
    return written(cases.table(spark, empty=True), "no-cases")


def by_row(rows, *names):
    """Multiset of rows by the given columns."""
    return Counter(tuple(r[n] for n in names) for r in rows)


def test_words_and_hashes():
    texts = [r[1] or "" for r in cases.rows()]
    for chunk in (1, 50, 1 << 20):
        got, names = [[] for _ in texts], {}
        for run in W.runs(pa.array(["skipped", *texts])[1:], chunk=chunk):
            starts, ends, doc = run.segments(W.SPACE)
            for a, b, d, h in zip(starts, ends, doc, run.hashes(starts, ends)):
                piece = run.data[a:b].tobytes()
                got[run.first + d].append(piece)
                assert names.setdefault(piece, h) == h
        assert got == [t.encode().split() for t in texts]
        assert len(set(names.values())) == len(names)


# ------------------------------------------------------------------------------ quality rules


def brute_signals(text):
    text = text or ""
    w = cases.words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (
        len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def test_quality_signals(docs, none):
    rows = quality.signals(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_signals(r.text)
        w, size = cases.words(r.text), quality.WINDOW
        begins = [max(0, min(i, len(w) - size)) for i in range(0, len(w), size)]
        windows = [w[i : i + size] for i in begins]
        assert (r.n_window_words, r.n_window_distinct) == (sum(map(len, windows)), sum(len(set(x)) for x in windows))
    signalled = quality.signals(docs)
    judged = quality.judged(signalled, quality.fit(signalled)).collect()
    for r in judged:
        n, _, _, _, repeats = brute_signals(r.text)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.kept and r.base_failed) and 0 <= r.quality <= 1
    empty = quality.signals(none)
    assert quality.judged(empty, quality.fit(empty)).count() == 0


def test_variety_votes_at_every_length(spark):
    """Texts shuffled from a few dozen words are against, prose is for, at 60 as at 6,000 words."""
    import random

    random.seed(5)
    few = [f"word{i}" for i in range(24)]
    texts = []
    for n in (150, 1900, 3000, 6000):
        texts.append((n, "few", " ".join(random.choices(few, k=n))))
        texts.append((n, "many", " ".join(f"w{random.randint(0, 5000)}" for _ in range(n))))
    frame = spark.createDataFrame(texts, "n int, kind string, text string")
    votes = quality.signals(frame).select("n", "kind", quality.rules()["variety"].alias("vote")).collect()
    assert all(r.vote == (-1 if r.kind == "few" else 1) for r in votes)


def test_kept_documents_follow_the_fitted_votes(spark, docs):
    """The verdict of every row from its votes, by a label model fitted row by row."""
    signalled = quality.signals(docs)
    rules = quality.rules()
    rows = quality.judged(signalled, quality.fit(signalled)).withColumns({f"v_{n}": v for n, v in rules.items()}).collect()
    votes = np.array([[r[f"v_{n}"] for n in rules] for r in rows], float)
    share, weights = quality.em(votes, np.ones(len(votes)))
    for r, own in zip(rows, votes):
        odds = math.log(share / (1 - share)) + sum(w[0] if v == 1 else w[1] if v == -1 else 0.0 for v, w in zip(own, weights))
        assert math.isclose(r.quality, 1 / (1 + math.exp(-odds)), rel_tol=1e-6, abs_tol=1e-9)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_label_model_finds_the_bad_class():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.85
    votes = np.column_stack([
        np.where(rng.random(4000) < p, 0, np.where((rng.random(4000) < a) == good, 1, -1)) for p, a in ((0.1, 0.95), (0.3, 0.9), (0, 0.97))
    ])
    share, weights = quality.em(votes, np.ones(4000))
    odds = np.log(share / (1 - share)) + (votes == 1) @ weights[:, 0] + (votes == -1) @ weights[:, 1]
    assert ((odds > 0) == good).mean() > 0.97 and abs(share - 0.85) < 0.05


# ------------------------------------------------------------------------------ near duplicates


def brute_fingerprint(text):
    w = cases.lowered(text)
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(values):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_simhash(docs, none):
    marked = written(simhash.fingerprints(docs, keep=["doc_id", "text"]), "marked")
    rows = simhash.linked(marked).collect()
    assert len(rows) == docs.count()
    prints = [brute_fingerprint(r.text) for r in rows]
    assert [r.fingerprint % (1 << 64) for r in rows] == prints
    classes = brute_classes(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[classes[p]] = min(r.doc_id, least.get(classes[p], r.doc_id))
    assert [r.component_id for r in rows] == [least.get(classes[p]) for p in prints]
    assert simhash.linked(simhash.fingerprints(none)).count() == 0
    kept = simhash.representatives(docs).collect()
    assert len(kept) == len(set(classes.values())) and kept[0].__fields__ == docs.columns
    assert simhash.representatives(none).count() == 0


def test_every_four_positions_hold_a_triple():
    from itertools import combinations

    assert all(any(set(t) <= set(four) for t in simhash.triples()) for four in combinations(range(8), 4))


@pytest.mark.parametrize("block", [3, 2048])
def test_links_of_crowded_lists(spark, block):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    values = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for s in seeds for _ in range(40)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fingerprint bigint")
    got = {r.fingerprint % (1 << 64): r["class"] % (1 << 64) for r in simhash.classes(frame, block).collect()}
    want = brute_classes(values)
    groups = lambda x: {frozenset(v for v in x if x[v] == c) for c in set(x.values())}
    assert groups(got) == groups(want)


@pytest.mark.parametrize("few", [1000, 3])
def test_components_of_a_long_chain_and_a_star(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)  # with 3 the star's centre is dealt in pieces
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}


# ------------------------------------------------------------------------------ packing


def test_stretches_tokenize_as_whole_texts():
    encoder = packing.Encoder(byte_bpe())
    odd = [" ", "  ", "a", "é", " ", "　", " ", "\n", "'s", "1", ".", "!?", "<|endoftext|>", "中", "\x85", "\x1f", "¿", " of", "-"]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(odd, rng.integers(0, 30))) for _ in range(1500)] + [r[1] or "" for r in cases.rows()]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for chunk in (200, 1 << 20):
        fresh = packing.Encoder(byte_bpe())
        got = [ids.tolist() for run in W.runs(pa.array(texts), chunk=chunk) for ids in fresh.ids(run)]
        assert got == want


@pytest.mark.parametrize("limits", [(2048, 64, None), (64, 3, 40)])
def test_packing(docs, none, limits):
    tokens, segments, loss = limits
    pieces = packing.packed(
        docs, byte_bpe(), keep=["doc_id", "score", "text"], prompt="TEXT_", max_tokens=tokens, max_segments=segments, max_loss_tokens=loss
    ).collect()
    tokenizer = packing.encoder(byte_bpe()).tokenizer
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        documents[p.doc_id, p.text].append(p)
    prompt_of = {(r.doc_id, r.text): r.TEXT_ or "" for r in docs.collect()}
    for held in sequences.values():
        held.sort(key=lambda p: p.offset)
        total, bears = 0, 0
        for p in held:
            assert p.offset == total
            total += p.length
            head = len(tokenizer.encode(prompt_of[p.doc_id, p.text], add_special_tokens=False).ids)
            bears += p.start + p.length - max(p.start, min(head, p.start + p.length))
        assert len(held) <= segments and bears <= (loss or tokens)
        assert total == tokens or total & (total - 1) == 0
    copies = Counter((r.doc_id, r.text) for r in docs.collect())
    for key, n in copies.items():
        text = key[1] or ""
        ids = [i for t in (prompt_of[key], text) for i in tokenizer.encode(t, add_special_tokens=False).ids] + [1]
        placed = Counter()
        for p in documents[key]:
            assert p.doc_tokens == len(ids)
            got = np.frombuffer(p.ids, "<u4").tolist()
            assert got == ids[p.start : p.start + p.length]
            placed.update(range(p.start, p.start + p.length))
        assert all(placed[i] == n for i in range(len(ids)))
    assert packing.packed(none, byte_bpe()).count() == 0


# ------------------------------------------------------------------------------ html


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("<p", ""), ("a < b", "a < b"), ("<p>x", "x"), ("<div>x</div", "x"), ("<p>&lt;b&gt; &amp copy</p>", "<b> & copy"),
    ("<nav><p>menu, menu</p></nav><article><h1>T</h1><p>One,  two<br>three.<p><b>Four</article><footer>f</footer>", "T\n\nOne, two three.\n\nFour"),
    ("<script>var t='</p>';</script><div class='ad'>Buy</div><main><p>Text, here.</p><div id='comments'><p>I, like, it.</p></div></main>", "Text, here."),
    ("<body><div class=cookie-notice><p>We, use, many, cookies, here.</p></div><div><p>Real, text.</p></div><aside><p>a, b, c</p></aside></body>", "Real, text."),
    ("<ul><li><a href=1>x</a><li><a href=2>y</a><li><a href=3>z</a></ul>", ""),
    ("<form><p>a, b</p></form><p title='x>y'>kept&nbsp;one</p><!-- <p>no</p> -->", "kept one"),
    *[(page.replace("%s", "<p>One, two, three long sentence.</p><p>Second, paragraph.</p>"), text.replace("%s", "One, two, three long sentence.\n\nSecond, paragraph.")) for page, text in (
        ("<div class='content no-sidebar'>%s</div>", "%s"), ("<main class='ad-free'>%s</main>", "%s"), ("<article class='post comments-open'>%s</article>", "%s"),
        ("<article class='x has-comment y'>%s</article>", "%s"), ("<form id='aspnetForm'><div>%s</div></form>", "%s"),
        ("<article>%s<section class='social-science'><p>On science.</p></section></article>", "%s\n\nOn science."),
        ("<article><header class='entry-header'><h1>T</h1><p>Lead.</p></header>%s</article>", "T\n\nLead.\n\n%s"),
        ("<article><div class='article-header'><h1>T</h1><p>Lead.</p></div>%s</article>", "T\n\nLead.\n\n%s"),
        ("<main><p>Short.</p><article>%s</article></main>", "Short.\n\n%s"),
        ("<div class='sidebar'>X y</div><div>%s</div><div id='comments'>%s%s%s</div>".replace("%s%s%s", "<p>I, like, it, a, lot.</p>" * 9), "%s"),
        ("<header>Site</header><div class='ad'>Buy, many, things, now, here, please</div><article><h1>T</h1>%s</article><footer>f</footer>", "T\n\n%s"),
        ("<body class='no-js'><form><div class='header'>Site</div><main>%s</main></form></body>", "%s"),
        ("<div class='main-sidebar'><p>a, b, c, d, e</p></div><article>%s</article>", "%s"),
        ("<main><article>%s</article><section class='comments-area'><p>bad, bad</p></section></main>", "%s"),
        ("<div class='sticky-newsletter'><p>Sign up, now</p></div><div>%s</div>", "%s"),
        ("<article>%s<div class='share-buttons'>Share</div></article><article class='teaser'><p>t</p></article>", "%s"),
    )],
    ("<article class='post'><header><h1>H</h1></header><section><p>A, b.</p></section><section><p>C, d.</p></section></article>", "H\n\nA, b.\n\nC, d."),
])
def test_main_text(page, text):
    assert extraction.main_text(page) == text


def test_extracted(spark):
    schema = "page_id bigint, url string, html string, text string"
    pages = [(1, None, None, "old"), (2, "u", "", None), (3, "u", "<p>x, y</p>", "old"), (3, "u", "<p>x, y</p>", "old"), (None, None, "<div>" * 20_000 + "deep", None)]
    rows = extraction.extracted(spark.createDataFrame(pages, schema)).collect()
    assert by_row(rows, "page_id", "text") == {(1, ""): 1, (2, ""): 1, (3, "x, y"): 2, (None, "deep"): 1}
    assert extraction.extracted(spark.createDataFrame([], schema)).count() == 0


# ------------------------------------------------------------------------------ mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mixing(docs, none):
    rows = mixing.mixed(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r.size == len(cases.words(r.text)) and 0 <= r.copies <= 3 and 0 <= r.rate <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
    want = brute_targets({s: sizes[s] for s in {r.source for r in rows}})
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
    again = mixing.mixed(docs).collect()
    assert by_row(rows, "doc_id", "copies") == by_row(again, "doc_id", "copies")
    assert mixing.repeated(mixing.mixed(docs)).count() == sum(r.copies for r in rows)
    assert mixing.mixed(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    frame = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.least(F.lit(8), F.floor(F.col("id") / 60)).cast("string")).alias("source"),
        F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).cast("int")).alias("text"),
    )
    rows = mixing.mixed(written(frame, "mix")).collect()
    got = Counter()
    for r in rows:
        got[r.source] += r.size * r.copies
    for s, target in {r.source: r.target for r in rows}.items():
        assert abs(got[s] - target) <= 0.02 * target
    # Rates are tilted exponentially: log rate over size is the same in a source, below the bound.
    for s in {r.source for r in rows}:
        slopes = [math.log(r.rate) / r.size for r in rows if r.source == s and r.rate < 3]
        assert not slopes or max(slopes) - min(slopes) < 1e-9


# ------------------------------------------------------------------------------ order minhash


def test_order_minhash(docs, none):
    rows = order_minhash.followed(docs, keep=["doc_id", "text"]).collect()
    ordered = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert len(rows) == docs.count()
    for i, r in enumerate(ordered):
        text, following = r.text or "", ordered[(i + 1) % len(ordered)].text or ""
        quarter = len(text) // 4
        new = text[: len(text) - quarter] + following[:quarter]
        own, other, changed = (order_minhash.fingerprint(x) for x in (text, following, new))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == order_minhash.text_of_fingerprint(own)
        assert r.edited_fingerprint == order_minhash.text_of_fingerprint(changed)
        assert r.near_edited == (own == changed).mean() and r.near_next == (own == other).mean()
    assert order_minhash.followed(none).count() == 0


def test_order_matters():
    import random

    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    print_ = order_minhash.fingerprint(text)
    swapped = order_minhash.fingerprint(text[1500:] + text[:1500])
    nearer = order_minhash.fingerprint(text[:1490] + "zzzzzzzzzz" + text[1500:])
    other = order_minhash.fingerprint("".join(rng.choice("abcdefgh ") for _ in range(3000)))
    assert order_minhash.likeness(print_, nearer) > 0.9 > 0.8 > order_minhash.likeness(print_, swapped) > order_minhash.likeness(print_, other)
    assert not order_minhash.fingerprint("").any()


def test_occurrence_numbers_by_brute_force():
    points = np.frombuffer(("abababababab" * 5 + "xyz").encode("utf-32-le"), np.uint32)
    assert len(set(order_minhash._numbered(points).tolist())) == len(points) - order_minhash.K + 1


# ------------------------------------------------------------------------------ language model


def brute_base(rows):
    tokens = [[*cases.lowered(r.text), None] for r in rows]
    counts = Counter(t for r, ts in zip(rows, tokens) if not r.held for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    return [
        (len(ts), sum(t in counts for t in ts), total, sum(math.log10((counts.get(t, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for t in ts))
        for ts in tokens
    ]


def test_language_model(docs, none, monkeypatch):
    rows = docs.withColumn("held", remainder("doc_id", 3) == 0)
    model = lm.train(rows.where("not held"))
    keep = ["doc_id", "text", "held", "labels"]
    whole = lm.scored(rows, model, keep=keep).collect()
    for r, (n, known, total, base) in zip(whole, brute_base(whole)):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0
    # Dealt probes, small blocks and a head that leaves rare words to the join change nothing.
    for block in (lm.BLOCK_BYTES, 3000):
        monkeypatch.setattr(lm, "BLOCK_BYTES", block)
        parted = lm.scored(rows, model, keep=keep, filter_bytes=0, head_words=10).collect()
        assert len(parted) == len(whole) and parted[0].__fields__ == whole[0].__fields__
        for name in ("n_known", "base_score", "score", "labels"):
            a = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r[name] or 0) for r in whole)
            b = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r[name] or 0) for r in parted)
            assert all(x[:3] == y[:3] and (x[3] == y[3] or math.isclose(x[3], y[3], rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b))
    assert lm.scored(none, model).count() == 0 == lm.scored(none, model, filter_bytes=0).count()
    untrained = lm.scored(rows, lm.train(none)).collect()
    assert len(untrained) == len(whole) and all(r.n_known == 0 and r.base_score == 0 for r in untrained)


def test_filter_never_understates():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    counts = np.minimum(rng.zipf(1.6, len(keys)), 1 << 40)
    words, _ = lm.segment(keys, counts)
    part = lm.Filter(words, np.zeros((1, 1), np.uint64), np.array([[len(words)]], np.uint64))
    got, want = part.levels(1, keys), np.searchsorted(lm.LEVELS, counts, side="right")
    assert (got >= want).all() and (got > want).mean() < 0.05
    strange = np.setdiff1d(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), keys)
    assert (part.levels(1, strange) > 0).mean() < 0.05


def test_levels_stand_for_their_counts():
    for c in (1, 2, 3, 4, 5, 100, 10**6):
        level = np.searchsorted(lm.LEVELS, c, side="right")
        assert lm.LEVELS[level - 1] <= c < lm.LEVELS[level] and abs(lm.LEVEL_COUNTS[level] - c) <= c / 2


# ------------------------------------------------------------------------------ licenses


def test_licenses(docs, none):
    phrases = [(label, licenses.words_of(p)) for label, p in licenses.PHRASES]
    rows = licenses.scanned(docs, keep=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        w = licenses.words_of(r.text or "")
        places = [(label, i) for label, p in phrases for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.first_word == min((i for _, i in places), default=None)
        assert r.last_word == max((i for _, i in places), default=None)
        assert r.base_labels == ",".join(sorted({label for label, _ in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scanned(none).count() == 0


def test_matching_statistics():
    scanner = licenses.Scanner()
    texts = [licenses.words_of(t) for _, t in [*licenses.PHRASES, *licenses.TEMPLATES]]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    sequences = [[number[w] for w in t] for t in texts]
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = sequences[rng.integers(len(sequences))], sequences[rng.integers(len(sequences))]
        at = rng.integers(len(a))
        query = [*a[at : at + 8], *b[:5], *rng.integers(0, len(number), 3).tolist()]
        for i, (state, length) in enumerate(scanner.automaton.statistics(query)):
            places = lambda n: [(k, e) for k, s in enumerate(sequences) for e in range(n - 1, len(s)) if s[e - n + 1 : e + 1] == query[i + 1 - n : i + 1]]
            assert length == max((n for n in range(1, i + 2) if places(n)), default=0)
            assert not length or scanner.automaton.ends[state] == places(length)


def test_templates_compete_for_a_notice(spark):
    gpl = {label: text for label, text in reversed(licenses.TEMPLATES) if label in ("gpl-2", "gpl-3")}
    notices = [
        ("gpl-2", gpl["gpl-2"]), ("gpl-3", gpl["gpl-3"]), ("agpl-3", gpl["gpl-3"].replace("General", "Affero General")),
        ("lgpl", gpl["gpl-2"].replace("General", "Lesser General").replace("program", "library").replace("version 2", "version 2.1")),
        ("lgpl", gpl["gpl-3"].replace("General", "Lesser General")),
        ("lgpl", gpl["gpl-2"].replace("General", "Lesser General").replace("version 2", "version 2.1")),
    ]
    frame = spark.createDataFrame([(i, f"some words {t} other words") for i, (_, t) in enumerate(notices)], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in licenses.scanned(frame).collect()}
    assert [got[i] for i in range(len(notices))] == [label for label, _ in notices]


def notices():
    """(label, text): every template as files carry it, and variants that differ in the telling words."""
    out = [(label, text) for label, text in licenses.TEMPLATES]
    text_of = dict(reversed(licenses.TEMPLATES))
    shout = lambda label: (label, text_of[label].upper())
    comment = lambda label: (label, "/*\n * " + "\n * ".join(text_of[label].split("\n")) + "\n */ int main()")
    out += [shout(x) for x in ("mit", "apache-2", "bsd-2", "gpl-2", "zlib")] + [comment(x) for x in ("isc", "gpl-3", "mpl-2", "lgpl", "epl-2")]
    bsd = text_of["bsd-3"].replace("the copyright holder nor", "Acme Corp. nor")
    disclaimer = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    out += [("bsd-3", bsd), ("bsd-3", bsd + disclaimer), ("bsd-2", text_of["bsd-2"] + disclaimer)]
    kinds = {
        "cc-by": "Attribution", "cc-by-sa": "Attribution-ShareAlike", "cc-by-nd": "Attribution-NoDerivs", "cc-by-nc": "Attribution-NonCommercial",
        "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike", "cc-by-nc-nd": "Attribution-NonCommercial-NoDerivs",
    }
    for label, kind in kinds.items():
        for tail in ("3.0 Unported", "2.5 Generic", "4.0 International"):
            out.append((label, f"This work is licensed under a Creative Commons {kind} {tail} License. To view a copy visit"))
    out.append(("mit,zlib", text_of["mit"] + " and of another file: " + text_of["zlib"]))
    return out


def test_every_notice_has_exactly_its_label(spark):
    rows = notices()
    assert len(rows) >= 70
    frame = spark.createDataFrame([(i, f"Copyright 2020 Some One\n{t}\nand then the code begins") for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in licenses.scanned(frame).collect()}
    wrong = [(label, got[i], text[:60]) for i, (label, text) in enumerate(rows) if got[i] != label]
    assert not wrong


@pytest.mark.parametrize("text", [
    "This work is licensed under a Creative Commons licence of some kind", "Permission is hereby granted to enter the building at night",
    "This program is free software; you can redistribute it and/or modify it under the terms of the Example Public License",
    "under the terms of the license agreement you may not use this file", "Redistribution and use in source and binary forms is forbidden",
    "This software is provided as-is, and the authors are very sorry", "All rights reserved. This program and the accompanying guide are sold",
    "This work is licensed under a Creative Commons Attribution-SomethingElse 4.0 International License",
    "the GNU General Public License is discussed in chapter 4 of this book by the Free Software Foundation", "apache, mit and bsd are licenses",
])
def test_near_notices_have_no_label(spark, text):
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert licenses.scanned(frame).first().labels == ""


def test_templates_survive_small_changes(spark):
    mit = licenses.TEMPLATES[0][1].replace("merge, publish", "merge, print, publish")
    frame = spark.createDataFrame([(1, "intro words here " + mit + " end")], "doc_id bigint, text string")
    (row,) = licenses.scanned(frame).collect()
    assert row.labels == "mit" and row.n_base == 0 and row.score > 0.9 and row.spans[0]["first"] == 3


def test_extraction_keeps_siblings_without_article():
    long = "".join(f"<p>Paragraph {i}, {'with many words, ' * 12}and an end.</p>" for i in range(10))
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Some other page {i}</a></li>" for i in range(5)) + "</ul>"
    page = (
        "<body><div><p>Short start.</p><h2>Heading</h2><div>" + long + "</div><ul><li>Item, with text</li></ul>"
        "Bare words.<table><tr><td>Cell</td></tr></table><pre>x = 1</pre><p><a href='/'>Only a link here</a></p>" + menu + "</div></body>"
    )
    got = extraction.main_text(page).split("\n\n")
    assert got[:2] == ["Short start.", "Heading"] and len(got) == 16
    assert got[-4:] == ["Item, with text", "Bare words.", "Cell", "x = 1"]


# ------------------------------------------------------------------------------ toxicity


def test_toxicity(spark, docs, none):
    import random

    rng = random.Random(7)
    common = ["".join(rng.choices(["an", "be", "co", "do"], k=rng.choice([2, 3]))) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        w = rng.choices(common, k=rng.randrange(5, 80))
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zorgon", "krelled", "krelling", "vuxo"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    given = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(frame, given.where(remainder("doc_id", 5) != 0))
    scores = {r.doc_id: r.toxicity for r in toxicity.scored(frame, model).collect()}
    held = [(scores[i], y) for i, y in labels if cases.crc(i) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) >= 0.97 * len(held)
    awkward = toxicity.scored(docs.withColumn("toxicity", F.lit("old")), model).collect()
    assert len(awkward) == docs.count() and all(0 <= r.toxicity <= 1 for r in awkward)
    assert {r.toxicity for r in awkward if not cases.words(r.text)} == {scores_of_nothing(model)}
    untaught = toxicity.train(none, given)
    assert all(r.toxicity < 0.5 for r in toxicity.scored(docs, untaught).collect())
    assert toxicity.scored(none, model).count() == 0


def test_toxicity_scores_are_those_of_plain_counts(spark, docs):
    """Every row's score from class counts that plain loops over its words give."""
    rows = [(i, f"plain words stand around {'zorgon krelled' if i % 4 == 0 else 'cleaner things'} in text {i}", int(i % 4 == 0)) for i in range(400)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.train(frame, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    class_of = dict(zip(model.units.tolist(), model.lexicon.classes.tolist()))
    texts = [r.text or "" for r in docs.select("text").collect()] + [t for _, t, _ in rows[:8]] + ["Zorgon zorgons KRELLED! kr*lled aaaah!!!"]
    got = toxicity._features(pa.array(texts), model.lexicon)
    for text, own in zip(texts, got):
        words = re.findall(r"[a-z\x80-\xff]+", text.encode().decode("latin-1").translate({c: c + 32 for c in range(65, 91)}))
        counts, strong, other = np.zeros(toxicity.CLASSES), 0, 0
        for w in words:
            word = w.encode("latin-1")
            units = [word, *(word[:k] for k in toxicity.PREFIXES if len(word) > k)]
            hit = [class_of[h] for u in units if (h := hash_of_bytes(u)) in class_of]
            for c in hit:
                counts[c] += 1
            strong += any(toxicity._STRONG[c] for c in hit)
            other += bool(hit) and not any(toxicity._STRONG[c] for c in hit)
        assert own[: toxicity.CLASSES].tolist() == counts.tolist() and own[-3:].tolist() == [len(words), strong, other]
    assert np.allclose(model.score(pa.array(texts)), 1 / (1 + np.exp(-np.clip(toxicity._inputs(got) @ model.weights, -35, 35))))
    assert len(model.units) and toxicity._cast(np.zeros((1, toxicity.CLASSES + toxicity._TAIL + 1), np.float32)).shape[1] == toxicity.BITS


def test_chance_units_are_bounded():
    """Units spread without regard to the label: of ten million no more than about a million reach the bound."""
    assert toxicity._least_ratio(10**5) == 0 and toxicity._least_ratio(10**9) > 13
    rng = np.random.default_rng(2)
    held = rng.integers(4, 40, 400_000)
    a = rng.binomial(held, 0.1)
    ratio = toxicity._ratio(a, held - a, 10_000, 90_000)
    assert (ratio >= toxicity._least_ratio(10**7)).mean() < 0.1


def hash_of_bytes(word):
    data = np.frombuffer(word, np.uint8)
    run = W.Run(0, 1, data, np.array([0, len(data)]))
    return int(run.hashes(np.array([0]), np.array([len(data)]))[0])


def test_toxicity_keeps_every_unit(spark):
    """Four hundred toxic words, one a text: far more units than columns."""
    import itertools

    bad = ["".join(p) + "zuk" for p in itertools.islice(itertools.product("bdfghklmn", "aeiou", "prstvwx", "aei"), 0, 800, 2)]
    rows = [(i, f"plain words stand around {bad[i % 400]} in text {i}", 1) for i in range(2400)]
    rows += [(2400 + i, f"plain words stand around clean{i % 40} in text {i}", 0) for i in range(7200)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(frame, labels)
    assert {hash_of(w) for w in bad} <= set(model.units.tolist())
    scores = model.score(pa.array([t for _, t, _ in rows]))
    assert all((s >= 0.5) == bool(y) for s, (_, _, y) in zip(scores, rows))


def test_toxicity_counts_all_labelled_rows(spark):
    """A word of eight toxic texts among three thousand, and a sample of three hundred for the classifier."""
    rows = [(i, f"plain words stand around {'zorgon' if i % 50 else 'vuxaly'} in text {i}", 1) for i in range(400)]
    rows += [(400 + i, f"plain words stand around clean{i % 40} in text {400 + i}", 0) for i in range(2600)]
    frame = spark.createDataFrame([r[:2] for r in [*rows, *rows]] + [(9999, rows[0][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    taught = toxicity.training_rows(frame, labels, "text", "doc_id", "toxic").collect()
    assert sorted((r.text, r.toxic) for r in taught) == sorted((t, y) for _, t, y in rows)
    assert hash_of("vuxaly") in toxicity.train(frame, labels, rows=300).units.tolist()


def hash_of(word):
    (run,) = W.runs(pa.array([word]))
    return int(run.hashes(np.array([0]), np.array([len(word)]))[0])


def scores_of_nothing(model):
    return model.score(pa.array([""]))[0]


# ------------------------------------------------------------------------------ url filters


def test_url_filters(spark):
    changes = [
        ("spam", "block", "bad.com", 100, "add"), ("spam", "block", "bad.com", 100, "add"), ("spam", "block", "bad.com", 200, "remove"),
        ("spam", "block", "bad.com", 300, "add"), ("spam", "block", "bad.com", 300, "remove"), ("trusted", "allow", "bad.com/ok", 0, "add"),
        ("ads", "block", "x.bad.com", 150, "add"), (None, "block", "y", 1, "add"), ("ads", "block", None, 1, "add"), ("ads", "block", "z", None, "add"),
    ]
    captures = [
        (1, "http://bad.com/a", 99, 1), (2, "http://bad.com/a", 100, 1), (3, "HTTP://u:p@X.Bad.com:80/ok/b?q#f", 199, 1), (4, "http://bad.com/ok", 150, 1),
        (5, "http://bad.com/a", 200, 1), (6, "http://bad.com/a", 300, 1), (7, "http://notbad.com/", 150, 1), (8, None, 150, 1), (9, "nonsense", 150, 1),
        (10, "http://bad.com/okay", 150, None), (2, "http://bad.com/a", 100, 1), (11, "http://bad.com/" + "s/" * 5000, 120, 1), (12, "http://bad.com", None, 1),
    ]
    frame = spark.createDataFrame(captures, "page_id bigint, url string, fetched bigint, n_active int")
    log = spark.createDataFrame(changes, "list string, kind string, pattern string, at bigint, action string")
    for bucket in (7, url_filters.BUCKET_SECONDS):
        rows = url_filters.filtered(frame, log, bucket_seconds=bucket).collect()
        assert by_row(rows, "page_id", "n_active", "lists", "pattern", "blocked") == {
            (1, 0, "", None, False): 1, (2, 1, "spam", "bad.com", True): 2, (3, 2, "ads,spam", "x.bad.com", True): 1,
            (4, 2, "spam,trusted", "bad.com/ok", False): 1, (5, 0, "", None, False): 1, (6, 0, "", None, False): 1, (7, 0, "", None, False): 1,
            (8, 0, "", None, False): 1, (9, 0, "", None, False): 1, (10, 1, "spam", "bad.com", True): 1, (11, 1, "spam", "bad.com", True): 1,
            (12, 0, "", None, False): 1,
        }
    assert url_filters.filtered(frame.limit(0), log).count() == 0
    assert url_filters.filtered(frame, log.limit(0)).where("blocked").count() == 0
