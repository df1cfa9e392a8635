"""A small table with every awkward case, and brute-force versions of what the operators compute."""

from __future__ import annotations

import random
import zlib

LONG = 60_000
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "score double, size bigint, TEXT_ string, labels string, sequence_id bigint, `odd name` int"
)


def rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows; clashing column names."""
    random.seed(11)
    syllables = "an be co do en fra gi hol im ju kra lo".split()

    def prose(n: int) -> str:
        return " ".join("".join(random.choices(syllables, k=random.choice([1, 2, 3]))) for _ in range(n))

    base = prose(120)
    texts = [
        None, "", " \t\n ", "one", "two words", "a b c", "a b c d", base, base, base.upper(), base + " more",
        prose(300), prose(80) + ".\n" + "again and again\n" * 6, "x" * 500, prose(LONG // 5),
        "Under the MIT License. apache license, version 2; CC-BY-NC", "é à ü 中文 " * 40, "# $ % & | < > * " * 30,
        "you loser idiot " * 30 + base, "<|endoftext|> literal", prose(60), prose(60),
    ]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, "en", f"s{i % 4}", len(t or ""), 0.5, 7, "x", "y", 3, 1))
    out.append((5, "a b c", "en", "s1", 5, 0.5, 7, "x", "y", 3, 1))  # a repeated row
    out.append((5, "a b c", "en", "s1", 5, 0.5, 7, "x", "y", 3, 1))
    out.append((None, base, None, None, None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None, None, None))
    out.append((100, prose(90), None, None, None, None, None, None, None, None, None))
    return out


def table(spark, empty: bool = False):
    return spark.createDataFrame([] if empty else rows(), SCHEMA)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def crc(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())
