"""Operators 12 and 13 against brute force, on SQL, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import op12_trie, op13_fim
from tests.llm.conftest import frame

SPACES = "[\x20\x09-\x0d]+"

# 12 --------------------------------------------------------------------------------------------------------------------


def brute_rebuild(rows):
    """conv_id -> rebuilt turns; rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20
        out[c] = own.get(c - base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        parents = {m[:-1] for m in below if m}
        n_words = lambda m: len([w for w in re.split(SPACES, m[-1][1]) if w]) if m else 0
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.add((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), sum(m not in parents for m in below),
            sum((len(members[m]) - 1) * n_words(m) for m in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(spark, rows):
    """Extra columns have names that the operator uses inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "conv_id long, turn long, role string, text string, node long, len long, pos long, n long")


def nodes(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_trie_equals_sql(spark, sf_dir, same):
    same(op12_trie.query(spark, sf_dir), op12_trie.ORACLE)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    """Few turns, so that most are shared; copies, prefixes, null turns, roles and texts, repeated rows, negative ids, deep chains."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), 61, 62, 63, 64, 65, 400, 403, 407, -3, -20, -41]:
        for turn in range(rng.randrange(0, 6)):
            rows.append((c, turn, rng.choice(["user", "user", None, ""]), rng.choice(["a b", "a b", "c", None, " x\ty ", "a  b"])))
    rows += [(c, t, "user", f"deep {t}") for c in (1000, 1001, 1003) for t in range(37)]
    rows += [(2000, t, "user", "own chain") for t in range(45)]
    rows += [(5, None, "user", "first"), (5, None, "user", "first"), (5, None, "assistant", "second"), (None, 1, "user", "no id"), (7, 2, "user", "again"), (7, 2, "user", "again")]
    got = nodes(op12_trie.trie(*op12_trie.rebuilt(op12_trie.numbered(conversations(spark, rows)))))
    assert len(got) == len(set(got))
    assert set(got) == brute_trie(brute_rebuild(rows))


def test_trie_as_they_are(spark):
    rows = [(c, t, "user", "x" if t < 3 else f"{c}") for c in range(1, 30) for t in range(5)] + [(50, t, "user", "long words " * 5000) for t in range(2)]
    convs = collections.defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role, text))
    assert set(nodes(op12_trie.trie(*op12_trie.plain(op12_trie.numbered(conversations(spark, rows)))))) == brute_trie(dict(convs))


def test_trie_hot_turn_rows_and_ends(spark):
    """One conversation with most rows, one first turn and end that most share, one turn repeated over and over."""
    rows = [(c, 0, "user", "hello") for c in range(9000)] + [(9001, t, "user", f"t{t}") for t in range(300)] + [(9003, 1, "user", "again")] * 500
    got = nodes(op12_trie.trie(*op12_trie.plain(op12_trie.numbered(conversations(spark, rows)))))
    ids = ",".join(map(str, range(9000)))
    by = {(r[0], r[1]): r for r in got}
    assert by[0, 1][2:] == (0, 9000, 0, 1, 8999, hashlib.sha256(ids.encode()).hexdigest())
    assert by[0, 0][3:6] == (9002, 3, 3) and len(got) == 2 + 300 + 500 and by[9003, 500][7] == hashlib.sha256(b"9003").hexdigest()


def test_trie_root_alone(spark):
    """Conversations that lose all their turns end at the root; one conversation; an empty table."""
    one = [(3, 0, "user", "a"), (3, 1, "user", "b")]
    assert set(nodes(op12_trie.trie(*op12_trie.plain(op12_trie.numbered(conversations(spark, one)))))) == brute_trie({3: [("user", "a"), ("user", "b")]})
    short = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 >= 1 and c % 20]
    rows = [(c, 0, "user", "gone") for c in short]
    got = nodes(op12_trie.trie(*op12_trie.rebuilt(op12_trie.numbered(conversations(spark, rows)))))
    assert set(got) == brute_trie({c: [] for c in short}) and len(got) == 1
    assert nodes(op12_trie.trie(*op12_trie.rebuilt(op12_trie.numbered(conversations(spark, rows).limit(0))))) == []


# 13 --------------------------------------------------------------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
    form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
    out = text if plain else f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, n, form, None if plain else len(p), None if plain else len(m), hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


ODD_TEXTS = [
    "", "a", "ab", "a1", "1a", "😀", "a😀b😀😀", "é́ combining", "日本語text", "\n", "a\nb\r\nc\n", " x\u0085", "<P>", "a<S>b", "<M", "S>x<", "<<S", "P><S", "\x00a\x00", "x" * 30000,
    "word " * 5000, "1" * 20000, "<p> <P >", "A-Z [^x] (?=y) \\Q", "  lead", "trail  ",
]


def test_fim_equals_sql(spark, sf_dir, same):
    same(op13_fim.query(spark, sf_dir), op13_fim.ORACLE)


def fim_rows(df):
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = op13_fim.restore(F.col("output"), F.col("form_" if "form_" in df.columns else "form"))
    lengths = [F.char_length("prefix").cast("long").alias("p"), F.char_length("middle").cast("long").alias("m")]
    n = "n_" if "n_" in df.columns else "n"
    return [tuple(r) for r in df.select("doc_id", n, "form", *lengths, digest(F.col("output")).alias("o"), digest(back).alias("r")).collect()]


def test_fim_against_brute_force(spark, odd, odd_rows, none):
    """Surrogate pairs, line breaks, regex characters, parts of markers, long runs; all cuts of a text come up over the ids."""
    rows = [(100 + 7 * k + i, t) for k, t in enumerate(ODD_TEXTS) for i in range(7)] + [(10_000 + i, "ab 1😀é-c<S d") for i in range(150)]
    want = sorted((brute_fim(d, t) for d, t in rows), key=repr)
    assert sorted(fim_rows(op13_fim.transform(frame(spark, rows))), key=repr) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    got = op13_fim.transform(odd)
    assert set(odd.columns) < set(got.columns) and got.select(*odd.columns).exceptAll(odd).count() == 0
    assert sorted(fim_rows(got), key=repr) == sorted((brute_fim(r[0], r[1]) for r in odd_rows), key=repr)
    assert op13_fim.transform(none).count() == 0


@pytest.mark.parametrize(
    ("grammar", "pattern"),
    [
        (op13_fim.TOKENS, "[A-Za-z]+|[^A-Za-z]"),
        (op13_fim.WORDS, "[A-Za-z0-9_\x80-\U0010ffff]+|[\x20\x09-\x0d]+|[^A-Za-z0-9_\x80-\U0010ffff\x20\x09-\x0d]"),
        (op13_fim.LINES, "[^\n]+|\n"),
        (op13_fim.CHARACTERS, r"[\s\S]"),
    ],
)
def test_boundaries_follow_the_grammar(spark, grammar, pattern):
    rows = spark.createDataFrame([(t,) for t in ODD_TEXTS if len(t) < 3000], "text string")
    for r in rows.select("text", op13_fim.pieces(F.col("text"), grammar).alias("u")).collect():
        assert r["u"] == re.findall(pattern, r["text"])
