"""Exact deduplication, Merkle proofs and conversation repair against brute force, on small odd tables."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import exact, merkle, queries, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, best boolean, bucket int, carried string, level int, hash string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 3, 7, True, 2, "c", 1, "h") for i, t in rows], DOCS)


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Exact deduplication


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(small(t), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        first = ids.index(keep) if known else 0
        out += [(i, keep, len(ids), k == first, sha(t)) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = [f"Text {rng.randint(0, 40)} É" for _ in range(150)] + ["hot"] * 80 + ["HOT"] * 20 + [None, "", " ", "é", "É", "x" * 30000, "X" * 30000]
    rng.shuffle(made)
    return [*enumerate(made), (None, "hot"), (None, "alone"), (None, "alone"), (5, "twice"), (5, "TWICE")]


def found_copies(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_copies(spark, texts):
    assert found_copies(exact.copies(frame(spark, texts))) == brute_copies(texts)
    assert exact.copies(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("bucket", "held", "rows"), [(64, 1 << 20, 1 << 18), (1 << 20, 40, 1 << 18), (200, 1 << 20, 3)])
def test_copies_when_little_fits(spark, texts, monkeypatch, bucket, held, rows):
    """Buckets that are cut again and again, and tasks' tables that are full after a few texts or rows."""
    monkeypatch.setattr(exact, "BUCKET", bucket)
    monkeypatch.setattr(exact, "HELD", held)
    monkeypatch.setattr(exact, "ROWS", rows)
    assert found_copies(exact.copies(frame(spark, texts).repartition(3))) == brute_copies(texts)


def test_buckets_fit_or_have_one_hash(spark, monkeypatch):
    monkeypatch.setattr(exact, "BUCKET", 100)
    rng = random.Random(1)
    rows = [(rng.getrandbits(63), 40, b"") for _ in range(200)] + [(1 << 40, 90, b"")] * 30
    contents = spark.createDataFrame(rows, "hash long, size long, content binary")
    out = exact._fitting(contents, 1)
    assert out.count() == len(rows)
    sizes = out.groupBy("level", "bucket", "hash").agg(F.max("size").alias("size")).groupBy("level", "bucket").agg(F.sum("size").alias("s"), F.count("*").alias("m")).collect()
    assert all(r.s <= 100 or r.m == 1 for r in sizes) and len(sizes) > 60
    assert out.groupBy("hash").agg(F.count_distinct("level", "bucket").alias("n")).where("n > 1").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.binary(max_size=2)), max_size=60))
def test_equal_hashes_are_told_apart_by_content(rows):
    table, known = exact.Contents(), {}
    for key, content in rows:
        assert table.place(key, content) == known.setdefault((key, content), len(known))


def test_a_full_table_grows():
    table = exact.Contents()
    numbers = [table.place(k % 7, str(k).encode()) for k in range(3000)]
    assert numbers == list(range(3000)) and [table.place(k % 7, str(k).encode()) for k in range(3000)] == numbers


def test_rows_without_copies_keep_their_columns(spark, texts):
    docs = frame(spark, texts)
    out = exact.without_copies(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.carried) for r in out.collect()), key=repr) == sorted(((i, "c") for i, _, _, kept, _ in brute_copies(texts) if kept), key=repr)


# Merkle proofs


def tree(hashes):
    """Levels of the tree, the leaves' first and the root's last."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def brute_proofs(rows):
    def leaf(i, source, lang, n, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i, leaf(i, source, lang, n, text), (source, lang, n, text)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([h for _, h, _ in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for at, g in enumerate(langs):
        for place, (i, own, (source, lang, n, text)) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            digest, proof = own, []
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0:
                digest = leaf(i, source, lang, None if n is None else n + 1, text)
            for levels, p in ((trees[g], place), (top, at)):
                for level in levels[:-1]:
                    other = level[p ^ 1 : (p ^ 1) + 1]
                    proof += other
                    digest = sha("".join(sorted([digest, *other], key=lambda h, d=digest, odd=p & 1: (h == d) == bool(odd)))) if other else sha(digest)
                    p >>= 1
            out.append((i, own, trees[g][-1][0], top[-1][0], sha("".join(proof)), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


PROVEN = "doc_id long, text string, lang string, source string, n_chars long, tree int, place int, n int, level int"


@pytest.mark.parametrize("height", [1, 2, 12])
def test_proofs(spark, tmp_path, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rng = random.Random(height)
    rows = [(i, rng.choice(["a", "é", None, "", "long " * 3000]), rng.choice(["en", "en", "en", "de", None, "zz"]), rng.choice(["s", None]), rng.choice([3, None])) for i in range(61)]
    rows += [(70, "alone", "É", "s", 1), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (3, "other", "en", "s", 5), (3, "other", "en", "s", 5)]
    spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], PROVEN).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_merkle_multiproof(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_proofs(rows)
    assert 0 < sum(not r.verified for r in out.collect()) < len(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_proofs_of_tiny_tables(spark, tmp_path, n):
    rows = [(7 + i, "t", None, None, None) for i in range(n)]
    spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], PROVEN).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_merkle_multiproof(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == (brute_proofs(rows) if rows else [])


def test_proofs_of_some_leaves(spark, monkeypatch):
    """Any rows can be claimed, repeated and wrong ones too; each block fetches no more than it needs."""
    monkeypatch.setattr(merkle, "HEIGHT", 3)
    leaves = spark.createDataFrame([("g" if i % 3 else "h", i, sha(str(i))) for i in range(100)], "g string, k long, hash string")
    made = merkle.manifest(leaves, "g", "k")
    some = made.leaves.where("k % 13 in (0, 1)")
    claims = some.withColumn("claimed", F.col("hash")).unionByName(some.where("k = 13").withColumn("claimed", F.lit("no")))
    out = merkle.prove(made, claims).collect()
    assert len(out) == 17 and all(r.verified == (r.claimed != "no") for r in out)
    trees = {g: tree([sha(str(i)) for i in range(100) if (i % 3 > 0) == (g == "g")]) for g in "gh"}
    assert made.root == tree([trees["g"][-1][0], trees["h"][-1][0]])[-1][0]
    for r in out:
        assert r.siblings == [level[q ^ 1] for levels, p in ((trees[r.g], r.place), (tree([trees["g"][-1][0], trees["h"][-1][0]]), "gh".index(r.g))) for k, level in enumerate(levels[:-1]) if (q := p >> k) ^ 1 < len(level)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(0, n - 1), min_size=1))))
def test_missing_nodes_are_the_least_that_prove(case):
    n, places = case
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) // 2)
    wanted = set(merkle.missing(sorted(places), n))
    under = lambda level, p: any(q >> level == p for q in places)
    needed = {(k, (p >> k) ^ 1) for p in places for k in range(len(sizes) - 1) if (p >> k) ^ 1 < sizes[k]}
    assert wanted == {(k, p) for k, p in needed if not under(k, p)}


# Conversation repair

TURNS = "conv_id long, turn long, role string, text string, place int, code int, audit string, cost int"


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired turns) of one conversation's rows in order."""
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = None

    def walk(k, roles, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        text = "".join(roles)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", text):
            best = min(best or (cost, audit), (cost, audit))
        if not re.fullmatch("s?(ua)*u?", text):
            return
        if len(roles) < len(rows) + 3:
            for r in "ua":
                walk(k, [*roles, r], cost + 2, audit + "I")
        if k < len(rows):
            walk(k + 1, roles, cost + 3, audit + "D")
            if faults[k] not in ("b", "d"):
                more = faults[k] == "t"
                if rows[k][1][:1]:
                    walk(k + 1, [*roles, rows[k][1][:1]], cost + more, audit + "K")
                for r in "ua":
                    walk(k + 1, [*roles, r], cost + 2 + more, audit + "R")

    walk(0, [], 0, "")
    cost, audit = best
    out, k = [], 0
    for letter in audit:
        due = "user" if not out or out[-1][0][:1] in "sa" else "assistant"
        if letter == "I":
            out.append((due, ""))
            continue
        if letter != "D":
            out.append((rows[k][1] if letter == "K" else due, rows[k][2]))
        k += 1
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, out


def odd_conversations(rng, n, most):
    """Rows of conversations of all sorts, with null ids, turns, roles and texts."""
    rows = []
    for c in [None, *range(n)]:
        for k in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "what ", "", None, " \n", f"word {k}.", f"word {k}? ", "long. " * 50])
            rows.append((c, rng.choice([k, k, k, k + 3, None]), role, text))
    rng.shuffle(rows)
    return rows


def by_conversation(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rs in out.items()}


@pytest.mark.parametrize(("stretch", "together"), [(16, 32), (2, 2)])
def test_repair(spark, monkeypatch, stretch, together):
    """Whole conversations, and ones that are searched in stretches which are put together in several rounds."""
    monkeypatch.setattr(repair, "STRETCH", stretch)
    monkeypatch.setattr(repair, "TOGETHER", together)
    rows = odd_conversations(random.Random(stretch), 40, 7)
    made = repair.repair(spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], TURNS))
    expected = {c: brute_repair(rs) for c, rs in by_conversation(rows).items()}
    assert {r.conv_id: tuple(r)[1:] for r in made.conversations.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").collect()} == {c: e[:7] for c, e in expected.items()}
    turns = {}
    for r in sorted(repair.repaired_turns(made).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: e[7] for c, e in expected.items() if e[7]}
    assert {r.conv_id: r.repaired_sha256 for r in repair.repaired_digests(made).collect()} == {c: sha("\n".join(f"{a}:{b}" for a, b in e[7])) for c, e in expected.items()}


def test_repair_of_nothing(spark):
    made = repair.repair(spark.createDataFrame([], TURNS))
    assert made.conversations.count() == 0 and repair.repaired_turns(made).count() == 0 and repair.repaired_digests(made).count() == 0


def test_repair_of_a_very_long_conversation(spark):
    """One conversation holds most rows; its stretches are searched by many tasks and agree with one search."""
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"text {k}{rng.choice(['.', ''])}") for k in range(400)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    made = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in made.conversations.collect()}
    codes = tuple((repair.USER if r[2] == "user" else repair.ASSISTANT) + (0 if r[3].endswith(".") else repair.TRUNCATED) for r in rows[:400])
    ways = {repair.NONE: (0, "")}
    for code in codes:  # the cheapest prefix for each role last given, with inserts before each row and at the end
        for _ in range(2):
            for last, (cost, audit) in list(ways.items()):
                then = repair.DUE[last]
                ways[then] = min(ways.get(then, (1 << 40, "")), (cost + 2, audit + "I"))
        new = {}
        for last, (cost, audit) in ways.items():
            for letter, more, then in repair._moves(code, last):
                new[then] = min(new.get(then, (1 << 40, "")), (cost + more, audit + letter))
        ways = new
    ways = {k: v for last, (cost, audit) in ways.items() for k, v in ((last, (cost, audit)), (repair.DUE[last], (cost + 2, audit + "I"))) if k in repair.ENDS} | {last: w for last, w in ways.items() if last in repair.ENDS}
    assert (out[1].cost, len(out[1].audit.replace("I", ""))) == (min(w[0] for w in ways.values()), 400)
    assert tuple(out[2])[1:] == (0, 0, 0, 0, 0, 0, "KK")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 4, 6, 7, 10, 11]), max_size=6))
def test_search_and_bounds(codes):
    """The search against all edits; a suffix never costs less than its bound."""
    def cheapest(codes, first):
        best, level = None, [(0, "", 0, first)]
        while level:
            following = []
            for cost, audit, at, last in level:
                if at == len(codes) and last in repair.ENDS:
                    best = min(best or (cost, audit), (cost, audit))
                if cost <= 3 * len(codes) + 4:
                    following.append((cost + 2, audit + "I", at, repair.DUE[last])) if audit[-2:] != "II" else None
                    following += [(cost + more, audit + letter, at + 1, then) for letter, more, then in (repair._moves(codes[at], last) if at < len(codes) else [])]
            level = following if best is None else [x for x in following if x[0] <= best[0]]
        return best

    codes = tuple(codes)
    assert repair.search(codes) == cheapest(codes, repair.NONE)
    for k, bound in enumerate(repair.suffix_bounds(codes)):
        assert bound <= min(cheapest(codes[k:], last)[0] for last in range(4) if cheapest(codes[k:], last))


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (*range(30), None) for t in (0, 1, None)]
    out = queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "One Two" if kind == 2 else text)
        expected += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)
