"""Whitening, personal data and token alignment against brute force, on awkward tables too."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402

from meshlight.llm import alignment, pii, queries, whitening  # noqa: E402
from meshlight.llm.queries import byte_bpe, piece_bpe  # noqa: E402
from meshlight.session import written  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return written(cases.table(spark), "cases")


@pytest.fixture(scope="module")
def none(spark):
    return written(cases.table(spark, empty=True), "no-cases")


# ------------------------------------------------------------------------------ whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, deviation int, whitened string, entry int, n int"


def vector_rows(n: int = 300, width: int = 6) -> list[tuple]:
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, width)) * np.array([9, 5, 5, 3, 1, 0.3])[:width]
    rows = [(i, [float(c) for c in v], 0, 1, "x", 2, 3) for i, v in enumerate(x)]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None, None, None)]
    for odd in (None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], [], [1.0, 2.0], [None] * 6):
        rows.append((900, odd, 1, 1, "y", 2, 3))
    return rows


def brute_numbers(rows):
    good = [r for r in rows if r[1] is not None and len(r[1]) == 6 and all(c is not None and np.isfinite(c) for c in r[1])]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r[1]] for r in good]
    return good, x


def test_whitening(spark):
    rows = vector_rows()
    table = written(spark.createDataFrame(rows, VECTORS).repartition(5), "vectors")
    good, x = brute_numbers(rows)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    model = whitening.fit(table)
    assert (model.n, model.width, model.rank) == (n, 6, 6)
    centred = np.array(x, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    assert np.allclose(model.values, values[::-1], rtol=1e-12)
    assert np.allclose(np.abs((model.vectors * vectors[:, ::-1]).sum(0)), 1, atol=1e-13)
    assert np.allclose(model.explained(), values[::-1] / values.sum(), rtol=1e-12)
    got = whitening.whitened(table, model, keep=["vec_id", "label"]).collect()
    assert len(got) == n and got[0].__fields__ == ["vec_id", "label", "deviation", "whitened"]
    deviations = Counter((r[0], sum((n * c - s) ** 2 for c, s in zip(v, sums))) for r, v in zip(good, x))
    assert Counter((r.vec_id, int(r.deviation)) for r in got) == deviations
    by_id = {r.vec_id: np.array(r.whitened) for r in got}
    for r, v in zip(good, centred):
        assert np.allclose(np.abs(by_id[r[0]]), np.abs(v @ vectors[:, ::-1] / np.sqrt(values[::-1])), atol=1e-10)
    assert whitening.identity_error(table, model) < 1e-10
    # Neither the order of the rows nor their partitions change the model.
    again = whitening.fit(table.repartition(2, "vec_id"))
    assert again.sums == model.sums and (again.vectors == model.vectors).all() and (again.values == model.values).all()


def test_whitening_of_few_and_of_large_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    model = whitening.fit(empty)
    assert whitening.whitened(empty, model).count() == 0 and whitening.identity_error(empty, model) is None
    alone = spark.createDataFrame([(1, [3.0, 4.0], 0, 0, "", 0, 0)], VECTORS)
    model = whitening.fit(alone)
    assert [tuple(r) for r in whitening.whitened(alone, model, keep=["vec_id"]).collect()] == [(1, 0, [None, None])]
    assert model.explained() == [None, None] and whitening.identity_error(alone, model) is None
    flat = [(i, [float(i), 2.0 * i, 7.0], 0, 0, "", 0, 0) for i in range(50)]  # one direction only
    model = whitening.fit(spark.createDataFrame(flat, VECTORS))
    rows = whitening.whitened(spark.createDataFrame(flat, VECTORS), model).collect()
    assert model.rank == 1 and all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in rows)
    huge = [(i, [1e30 if i % 7 else 3e16, float(i) * 1e12, i / 10], 0, 0, "", 0, 0) for i in range(40)]
    table = spark.createDataFrame(huge, VECTORS)
    model = whitening.fit(table)
    x = [[max(-whitening.LIMIT, min(whitening.LIMIT, int(np.floor(64 * float(np.float32(c)))))) for c in r[1]] for r in huge]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    assert model.sums == sums
    exact = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    got = {r.vec_id: r.deviation for r in whitening.whitened(table, model, keep=["vec_id"]).collect()}
    assert [got[i] for i in range(40)] == [e if e < 10**38 else None for e in exact]


@pytest.mark.parametrize("values", [
    np.linspace(1, 10, 40),
    [1 + 1e-9 * i for i in range(10)] + [2.0, 3.0, 4.5],  # a cluster that single precision cannot see into
    [5.0] * 6 + [1 + 1e-12 * i for i in range(5)] + [0.0] * 3,  # equal values, a tight cluster, no variance
    [1e6] + [1e-3 * (1 + 1e-7 * i) for i in range(8)],
])
def test_eigenpairs_of_clustered_values(values):
    rng = np.random.default_rng(8)
    d = len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (3 * np.eye(d) - q.T @ q) / 2
    a = (q * np.array(values, np.longdouble)) @ q.T
    found, x = whitening.eigenpairs((a + a.T) / 2)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-15 * max(values)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-15
    assert np.abs(a @ x - x * found).max() < 1e-15 * max(values)
    if np.diff(np.sort(values)).min() > 1e-10 * max(values):
        assert np.abs(np.abs((x * q[:, np.argsort(values)[::-1]]).sum(0)) - 1).max() < 1e-12


# ------------------------------------------------------------------------------ personal data

BASE_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in enumerate(BASE_PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            valid = (
                True, all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")) if kind == 1 else False,
                14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15,
            )[kind]
            if valid:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    random.seed(3)
    alphabets = ("a@.1", "@.-a1 ", "12. ", "1 -2", "+1 ().-2", "+12345 -.@a", "0123456789 -", "é@a.1\U0001f600")
    texts = ["".join(random.choices(random.choice(alphabets), k=random.randint(0, 40))) for _ in range(30_000)]
    texts += ["1.2.3.4.5.6.7.8.9", "9" * 5000 + ".1.1.1", "a@" * 500, "+" * 300 + "1 " * 400, "1." * 3000, "1-" * 9000]
    for text in texts:
        assert [s for s in pii.spans(text) if s[1] < 4] == brute_spans(text)


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail john.doe (at) example dot com or so", "masked_email", "john.doe (at) example dot com"),
    ("jane[at]mail.example.org.", "masked_email", "jane[at]mail.example.org"),
    ("see https://bob:pw@host.example:8080/x?y now", "login", "https://bob:pw@host.example:8080/x?y"),
    ("from 2001:db8::ff00:42:8329, at 12:30:45", "ip6", "2001:db8::ff00:42:8329"),
    ("IBAN: DE89 3704 0044 0532 0130 00 and more", "iban", "DE89 3704 0044 0532 0130 00"),
    ("Account number: 00123-45678.", "account", "00123-45678"),
    ("SSN 123-45-6789", "account", "123-45-6789"),
    ("passport no. X1234567", "account", "X1234567"),
    ("at 221B Baker Street, London", "street", "221B Baker Street"),
])
def test_added_spans(text, kind, found):
    named = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.spans(text)]
    assert named.count((kind, found)) == 1 and all(k == kind or k in pii.BASE for k, _ in named)


@pytest.mark.parametrize("text", [
    "meet me (at) noon", "IBAN: DE89 3704 0044 0532 0130 01", "the account number is secret", "ssnake 123456789",
    "a long street", "in 1999 the Street was empty", "https://example.org/@handle", "10:20:30", "std::vector::at",
])
def test_near_misses_have_no_span(text):
    assert pii.spans(text) == []


def test_scanned_rows(spark, docs, none):
    rows = pii.scanned(docs).collect()
    assert len(rows) == docs.count() and rows[0].__fields__ == [*docs.columns, "found"]
    for r in rows:
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.found] == pii.spans(r.text or "")
    assert pii.scanned(none).count() == 0


def test_personal_data_query(spark, tmp_path):
    texts = [None, "", "a.b@c.de and 10.0.0.1, +1 (017) 555-7713", "x@y.z" * 3, "IBAN DE89370400440532013000"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.QUERIES["op12_personal_data"](spark, str(tmp_path)).collect():
        base = brute_spans(texts[r.doc_id] or "")
        written_out = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(written_out.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert set(filter(None, written_out.split(","))) <= set(r.spans.split(","))


# ------------------------------------------------------------------------------ token alignment


def byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + n)], n = b, n + 1
    return table


@pytest.fixture(scope="module")
def brute_alignment():
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe())
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=piece_bpe())
    to_byte = byte_of()

    def run(text: str | None):
        """n_a, n_b, n_groups, the links, the groups' digest."""
        whole = b" " + (text or "").encode()
        a = tokenizer.encode(whole.decode(), add_special_tokens=False).ids
        b = model.encode(text or "")
        a_bytes = [bytes(to_byte[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b
        ]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return 0, 0, 0, [], ""
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        links, j = [], 0
        for i, end in enumerate(a_ends):
            begin = a_ends[i - 1] if i else 0
            while b_ends[j] <= begin:
                j += 1
            k = j
            while k < len(b) and (k == 0 or b_ends[k - 1] < end):
                links.append((a[i], b[k]))
                k += 1
        shared, groups, i, j = sorted(set(a_ends) & set(b_ends)), [], 0, 0
        for end in shared:
            i2, j2 = int(np.searchsorted(a_ends, end)) + 1, int(np.searchsorted(b_ends, end)) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    return run


@pytest.mark.parametrize("block_bytes", [4 << 20, 3000, 1])
def test_alignment(docs, none, brute_alignment, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    rows = alignment.aligned(docs, byte_bpe(), piece_bpe()).collect()
    assert len(rows) == docs.count()
    brute = [brute_alignment(r.text) for r in rows]
    documents = Counter(link for x in brute for link in set(x[3]))
    top: dict[int, int] = {}
    for (a, _), n in documents.items():
        top[a] = max(n, top.get(a, 0))
    for r, (n_a, n_b, n_groups, links, digest) in zip(rows, brute):
        best = sum(documents[x] == top[x[0]] for x in links)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) == (
            n_a, n_b, n_groups, len(links), digest, best, sum(documents[x] for x in links)
        )
    index = alignment.indexed(docs, byte_bpe(), piece_bpe(), keep=[])
    counts = {(r.a, r.b): (r.documents, r.links, r.best) for r in alignment.pair_counts(index).collect()}
    links = Counter(link for x in brute for link in x[3])
    assert counts == {x: (documents[x], links[x], documents[x] == top[x[0]]) for x in links}
    assert alignment.aligned(none, byte_bpe(), piece_bpe()).count() == 0


def test_long_texts_reach_the_piece_model_in_stretches(monkeypatch):
    model = alignment.PieceEncoder(piece_bpe())
    random.seed(2)
    texts = ["".join(random.choices(["ab", "c", " ", "  ", "\n", "é", "12", "▁", "."], k=400)) for _ in range(50)] + ["", " ", "   ", "a  "]
    whole = [model.model.encode(t) for t in texts]
    monkeypatch.setattr(alignment, "PIECE_BYTES", 5)
    assert [x.tolist() for x in model.ids([t.encode() for t in texts])] == whole


def test_bitmaps_listed_and_dense():
    rng = np.random.default_rng(6)
    sizes = [0, 1, 255, 256, 257, 3000, alignment.BLOCK_DOCS, 2]
    members = [np.sort(rng.choice(alignment.BLOCK_DOCS, n, replace=False)) for n in sizes]
    bitmaps = alignment._compressed(np.repeat(np.arange(len(sizes)), sizes), np.concatenate(members), len(sizes))
    assert max(len(x.as_py()) for x in bitmaps) == alignment.DENSE
    at, slot = alignment.members(bitmaps)
    for i, m in enumerate(members):
        assert np.sort(slot[at == i]).tolist() == m.tolist()
