"""Cutting texts: borders as rows and rules as columns against the form for one text; tokenizers; sections in one pass."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from corpusmill.functions import tokenizers as tk
from corpusmill.operators import parts, sections, splitting

PIECES = [
    "A sentence here. ", "another one\n\n", "$x. Y$ ", "More words! ", "\n\n", "e.g. ", "i.E.\n\nNext", "It follows:\n\n", "a hyphen-\n\nated ", "# Heading\n\n", "$$a\n\nb$$", "\n\n$$x$$\n\n",
    "(Brackets too) end! ", "\\cite{x} goes on? ", "4 digits. ", 'He "said." ', "é 中文。 ", "\\begin{align}a\n\nb\\end{align} ", "\r\n\r\n", "   ", "Long " * 30 + ". ", "\x1c\n\n\x85", "$$open ",
]


def letters():
    """A tokenizer with a token for every sign that isn't blank; made here, so that it travels to the tasks by value."""

    class Letters:
        name = "letters"

        def spans(self, text):
            at = np.array([i for i, c in enumerate(text) if not c.isspace()], np.int64)
            return at, at + 1

    return Letters()


def made(rng, n):
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(n)] + ["", None, "word", " \n\n \n\n ", "no end " * 300]


@pytest.mark.parametrize(("limit", "overlap", "least", "tokenizer"), [(8, 0, 20, tk.Words()), (20, 6, 0, tk.Words()), (40, 25, 30, letters()), (256, 0, 20, tk.Words())])
def test_parts_equal_the_form_for_one_text(spark, limit, overlap, least, tokenizer):
    texts = made(random.Random(limit), 120)
    rows = spark.createDataFrame([(None if i == 5 else i, i % 3, t) for i, t in enumerate(texts)], "doc_id int, pos int, text string").repartition(3)
    found = parts.measured(rows, tokenizer, limit)
    out = {(r.doc_id, r.pos): r.parts for r in parts.parts(found, ["doc_id", "pos"], limit, overlap, least).collect()}
    big = {(None if i == 5 else i, i % 3): t for i, t in enumerate(texts) if t and len(tokenizer.spans(t)[0]) > limit}
    assert out == {k: splitting.split(t, limit, overlap, least, tokenizer) for k, t in big.items()}
    assert {(r.doc_id, r.pos): r.tokens for r in found.collect()} == {(None if i == 5 else i, i % 3): len(tokenizer.spans(t)[0]) if t else 0 for i, t in enumerate(texts)}


def test_units_are_paragraphs_and_sentences_of_long_ones(spark):
    text = "One. Two two two two. Three\n\nShort para. Stays.\n\nIt ends:\n\nnot here."
    found = parts.measured(spark.createDataFrame([(1, text)], "doc_id int, text string"), tk.Words(), 5)
    units = [text[r.start : r.end].strip() for r in parts.units(found, ["doc_id"], 5).orderBy("start").collect()]
    assert units == ["One.", "Two two two two.", "Three", "Short para. Stays.", "It ends:\n\nnot here."]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "doc_id int, text string")
    assert parts.parts(parts.measured(rows, tk.Words(), 5), ["doc_id"], 5).count() == 0 and sections.nodes(rows).count() == 0


def test_two_tokenizers_give_two_trees(spark):
    text = "# Intro\n\n" + "\n\n".join(f"Paragraph number {i} has some words." for i in range(30))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    trees = {}
    for name in (None, "byte_bpe_50k.json"):
        tokenizer = tk.Library(public_tokenizers.path(name)) if name else tk.Words()
        out = sections.nodes(docs, max_tokens=40, tokenizer=tokenizer, overlap=15).orderBy("part").collect()
        trees[name] = [r.text for r in out if r.part]
        assert all(len(tokenizer.spans(x)[0]) <= 40 + 2 * x.count("\n\n") for x in trees[name])  # blank lines between units may be tokens
        assert {(r.metadata["tokenizer"], r.metadata["overlap"], r.metadata["strategy"]) for r in out} == {(name or "words", "15", "paragraphs and sentences")}
        # With an overlap parts begin inside the one before.
        assert any(b.split("\n\n")[0] in a for a, b in zip(trees[name], trees[name][1:]))
    assert trees[None] != trees["byte_bpe_50k.json"]


@pytest.mark.parametrize("tokenizer", [tk.Words(), tk.Library(public_tokenizers.path("byte_bpe_50k.json"))])
def test_offsets_in_arrow(spark, tokenizer):
    texts = ["Some words, and é 中.", None, "", "one"]
    lists = tk.offsets(pa.array(texts), tokenizer).to_pylist()
    assert lists[1] is None and lists[2] == []
    assert [texts[0][s["first"] : s["last"]].strip() for s in lists[0]] and "".join(texts[0][s["first"] : s["last"]] for s in lists[0]).replace(" ", "") == texts[0].replace(" ", "")
    out = tk.with_token_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", tokenizer).orderBy("i").collect()
    assert [None if r.spans is None else [s.asDict() for s in r.spans] for r in out] == lists
    first, last = tokenizer.spans(texts[0])
    assert tk.overlapping(first, last, 0, len(texts[0])) == len(first) and tk.overlapping(first, last, 1, 2) == 1 and tk.overlapping(first, last, 4, 4) <= 1


def test_formulas(spark):
    rows = spark.createDataFrame([(1, "a $b$ \\(c\\) $$d\n$$ \\[e\\] $$open"), (2, None), (3, "none")], "i int, text string")
    out = {r.i: None if r.spans is None else [(s.kind, s.first, s["last"]) for s in r.spans] for r in parts.math_spans(rows, "text").collect()}
    assert out == {1: [("inline", 2, 5), ("inline", 6, 11), ("display", 12, 18), ("display", 19, 24)], 2: None, 3: []}


def brute_sections(heads, least):
    """(title, parent_pos, path, text) of the kept headings of one document, by a plain walk."""
    boiler, out, limit, stack, held = ("references", "thanks"), [], None, [], ""
    for pos, (level, title, body, last) in enumerate(heads):
        if any(title.lower() == b or title.lower().startswith(b + " ") for b in boiler):
            limit = level
            continue
        if limit is not None and level > limit:
            continue
        limit = None
        stack = [x for x in stack if x[0] < level] if not stack or stack[-1][0] >= level else stack
        while stack and stack[-1][0] >= level:
            stack.pop()
        path = "/".join([*(x[2] for x in stack), title])
        whole = "\n".join(x for x in (held, body) if x)
        held = whole if 0 < len(whole) < least and not last else ""
        out.append((pos, stack[-1][1] if stack else None, path, "" if held else whole))
        stack.append((level, pos, title))
    return out


def test_sections_in_one_pass(spark):
    rng = random.Random(4)
    data, expected = [], {}
    for doc in [None, *range(60)]:
        heads = [(rng.randint(1, 4), rng.choice(["A", "B c", "References", "Thanks to all", ""]), rng.choice(["", "short", "x" * 25, "mid text 12345", None]), False) for _ in range(rng.randint(1, 25))]
        heads[-1] = (*heads[-1][:3], True)
        data += [(doc, pos, *h) for pos, h in enumerate(heads)]
        expected |= {(doc, pos): (parent, path, text) for pos, parent, path, text in brute_sections(heads, 20)}
    rng.shuffle(data)
    rows = spark.createDataFrame(data, "doc_id int, pos int, level int, title string, body string, last boolean")
    out = {(r.doc_id, r.pos): (r.parent_pos, r.path, r.text or "") for r in sections.kept_tree(rows).collect()}
    assert out == expected
    apart = sections.with_carried(sections.with_hierarchy(sections.kept_sections(rows)))
    assert {(r.doc_id, r.pos): (r.parent_pos, r.path, r.text or "") for r in apart.collect()} == expected


@pytest.mark.parametrize("limit", [1, 10, 256])
def test_packed_units(spark, limit):
    rng = random.Random(limit)
    data = [(d, u, rng.choice([0, 1, 3, 9, 40, 300])) for d in [None, *range(30)] for u in range(rng.randint(1, 40))]
    expected, now = [], None
    for d, u, n in data:
        if now and now[0] == d and now[4] + n <= limit:
            now[3], now[4] = u, now[4] + n
        else:
            now = [d, now[1] + 1 if now and now[0] == d else 0, u, u, n]
            expected.append(now)
    shuffled = spark.createDataFrame(rng.sample(data, len(data)), "doc_id int, unit int, tokens long")
    out = sections.packed(shuffled, limit).select("doc_id", "window", "first", "last", "tokens").collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, expected), key=repr)
