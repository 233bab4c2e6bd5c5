import math
import re
import textwrap

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tidegrid.llm import chat, licenses, tokencount
from tidegrid.llm.packing import reference_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_parse_levels():
    body, quoted = chat.parse("> > deep\n> mid one\n> mid two\nanswer\n>> again\nend")
    assert body == "answer\nend" and quoted == [(2, "deep"), (1, "mid one\nmid two"), (2, "again")]


MESSAGE = "conv_id long, turn long, role string, text string"


def plain_conversations(rows, lead):
    """By direct search: parent of each message, then a depth-first walk. lead: for each row the number that orders those of one (conv_id, turn)."""
    keys = sorted({(c, t, lead[c, t, *x]) for c, t, *x in rows if c is not None and t is not None})
    text = {(c, t, lead[c, t, *x]): x[1] for c, t, *x in rows}
    body, quoted = {}, {}
    for k in keys:
        body[k], quoted[k] = chat.parse(text[k] or "")
    own = {k: set(chat.units(body[k])) for k in keys}
    parent = {}
    for k in keys:
        near, far = [], []
        for level, passage in quoted[k]:
            for h, words in chat.units(passage).items():
                inside = [o for o in keys if o[0] == k[0] and h in own[o]]
                if inside and min(inside)[1] < k[1]:
                    near.append((level, -min(inside)[1], min(inside)))
                outside = [o for o in keys if o[0] != k[0] and h in own[o]]
                if words >= chat.FAR_WORDS and outside:
                    far.append((level, -words, min(outside)))
        if near or far:
            parent[k] = min(near)[2] if near else min(far)[2]
    up = dict(parent)
    for k in keys:  # in order, so the smallest of a circle is met first
        seen, at = [k], up.get(k)
        while at is not None and at not in seen:
            seen.append(at)
            at = up.get(at)
        if at is not None:
            del up[min(seen[seen.index(at) :])]
    kids = {}
    for k, p in sorted(up.items()):
        kids.setdefault(p, []).append(k)
    place = {}
    for root in (k for k in keys if k not in up):
        stack, n = [(root, 0)], 0
        while stack:
            k, depth = stack.pop()
            place[k] = (root, depth, n)
            n += 1
            stack += [(x, depth + 1) for x in reversed(kids.get(k, []))]
    out = []
    for c, t, *x in rows:
        k = (c, t, lead[c, t, *x])
        root, depth, n = place.get(k, ((c, t), 0, 0))
        out.append((c, t, x[0], chat.parse(x[1] or "")[0], *(parent[k][:2] if k in parent else (None, None)), *root[:2], depth, n))
    return out


def said(df):
    return [(r.conv_id, r.turn, r.role, r.body, r.parent_conv, r.parent_turn, r.root_conv, r.root_turn, r.depth, r.position) for r in chat.conversations(df).collect()]


def test_conversations(spark):
    rows = [
        (1, 0, "user", "How do I  sort?"), (1, 1, "assistant", "Use sorted().\nIt is a stable sort."), (1, 2, "user", "> use Sorted()\nThanks"), (1, 3, "assistant", ">> Use sorted().\n> thanks\nWelcome"),
        (2, 0, "user", "> It is a stable sort.\nReally?"), (2, 1, "user", None), (2, 2, "user", "> nobody said this\nx"), (None, 0, "user", "> Thanks\ny"), (3, 0, "user", "> Welcome\nshort units stay at home"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], MESSAGE + ", depth int, M int")
    got = {(r.conv_id, r.turn): (r.body, r.parent_conv, r.parent_turn, r.root_conv, r.root_turn, r.depth, r.position) for r in chat.conversations(df).collect()}
    assert got == {
        (1, 0): ("How do I  sort?", None, None, 1, 0, 0, 0), (1, 1): ("Use sorted().\nIt is a stable sort.", None, None, 1, 1, 0, 0), (1, 2): ("Thanks", 1, 1, 1, 1, 1, 1), (1, 3): ("Welcome", 1, 2, 1, 1, 2, 2),
        (2, 0): ("Really?", 1, 1, 1, 1, 1, 3), (2, 1): ("", None, None, 2, 1, 0, 0), (2, 2): ("x", None, None, 2, 2, 0, 0), (None, 0): ("y", None, None, None, 0, 0, 0), (3, 0): ("short units stay at home", None, None, 3, 0, 0, 0),
    }
    assert chat.conversations(df.limit(0)).collect() == []


def planted(seed, conversations=12, turns=14):
    """Messages with known parents: quotations of one to three levels, whole, by lines or with a changed sentence, a line that everyone writes, chains, and quotations of other conversations."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**7, n)) + "."
    rows, want = [], {}
    for c in range(conversations):
        for t in range(turns):
            text = "\n".join(fresh(int(rng.integers(5, 9))) + " " + fresh(6) for _ in range(int(rng.integers(1, 4)))) + "\nOk, thanks."
            if rows and (t or rng.random() < 0.4) and rng.random() < 0.8:
                own = [r for r in rows if r[0] == c]
                p = own[-1] if own and rng.random() < 0.5 else own[rng.integers(len(own))] if own else rows[rng.integers(len(rows))]
                lines = [x for x in p[3].split("\n") if x != "Ok, thanks."]
                body = [x for x in lines if not x.startswith(">")]
                kind = rng.integers(3)
                cut = body if kind == 0 else body[:1] if kind == 1 else [body[0].replace(body[0].split(" ")[0], "changed", 1)]
                deeper = [">" + x for x in lines if x.startswith(">")]
                text = "\n".join([*deeper, *(f"> {x.upper()}" for x in cut), text])
                want[c, t] = p[:2]
            rows.append((c, t, "user", text))
    return rows, want


def test_conversations_against_brute_force_and_plan(spark):
    for seed in (1, 2):
        rows, want = planted(seed)
        rows += rows[5:8] + [(0, 3, "tool", rows[3][3] + "\nanother text of the same turn"), (2, None, "user", "x"), (4, 0, "x", "> one two three four five six\nseven eight nine ten"), (5, 0, "x", "> seven eight nine ten\none two three four five six")]
        df = spark.createDataFrame(rows, MESSAGE).repartition(7)
        got = said(df)
        lead = {tuple(r)[:4]: r.x for r in df.withColumn("x", F.xxhash64("role", "text")).collect()}
        assert sorted(map(str, got)) == sorted(map(str, plain_conversations(rows, lead)))
        clear = {k: v for k, v in want.items() if k not in {(0, 3), (4, 0), (5, 0)}}
        links = {r[:2]: r[4:6] for r in got if r[4] is not None}
        right = sum(links.get(k) == v for k, v in clear.items())
        assert right / len(clear) > 0.97 and right / len([k for k in links if k in clear or k not in want]) > 0.95


def test_long_chains_hot_messages_and_circles(spark):
    line = lambda i: f"message number {i} says something of its own"
    chain = [(1, i, "u", (f"> {line(i - 1)}\n" if i else "") + line(i)) for i in range(150)]
    hot = [(2, 0, "u", "everybody answers this first message")] + [(2, i, "u", f"> everybody answers this first message\nanswer {i}") for i in range(1, 200)]
    circle = [(10 + i, 0, "u", f"> the words of conversation {(i + 1) % 5} quoted around\nthe words of conversation {i} quoted around") for i in range(5)]
    got = {r[:2]: r for r in said(spark.createDataFrame(chain + hot + circle, MESSAGE).repartition(9))}
    assert all(got[1, i][6:] == (1, 0, i, i) for i in range(150))
    assert all(got[2, i][6:] == (2, 0, min(i, 1), i) for i in range(200))
    assert [got[10 + i, 0][6:] for i in range(5)] == [(10, 0, 0, 0)] + [(10, 0, 5 - i, 5 - i) for i in range(1, 5)] and got[10, 0][4:6] == (11, 0)


LICENSE_ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x", "plain text here"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (4, "a/b/c/y", "none"),
    (5, "z/q", "words " * 50 + "\nLicensed under CC BY-NC 4.0."), (6, "z/r", None), (7, None, ""), (8, "a/k", "This work is licensed under the GNU General Public License, version 3."),
    (9, "u/LICENSE", "This is licensed under the ISC License."), (10, "u/v", "x"), (11, "w/COPYING", "GNU Lesser General Public License version 2.1"), (12, "w/v/v", "x"), (13, "p/LICENSE", "Licensed under the Foo Public License. All rights reserved."), (14, "p/x", None),
    (15, "t/LICENSE", "Licensed under CC BY 4.0"), (15, "t/LICENSE.txt", "Released under the MIT License"), (16, "t/x", "tie"), (16, "t/x", "tie"), (None, "t/y", "null id"), (17, "r/x", "see LICENSE, version 2, of the GNU General Public License version 2 (or 3)"),
    (18, "r/x", "either version 3 of the License\n * under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or later"), (19, "r/y", "// SPDX-License-Identifier: LGPL-3.0-or-later"), (20, "r/z", "a driving licence is required " * 40),
]


def plain_licenses(rows):
    """Each window near a licence word against each template by the definition, then a walk up the directories."""

    def weighed(ws, templates):
        n = len(templates)
        v = {w: (1 + math.log(ws.count(w))) * (math.log((n + 1) / (sum(w in t for t in templates) + 1)) + 0.1 if any(w in t for t in templates) else math.log(n + 1) + 0.1) for w in set(ws)}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / size for w, x in v.items()}

    cosine = lambda x, y: sum(x[w] * y[w] for w in x if w in y)
    heads = [(k, licenses.words(t)) for k, ts in licenses.TEMPLATES.items() for t in ts]
    texts = [(k, licenses.words(licenses.OWNER.sub(" ", t))) for k, t in licenses.whole_texts().items()]
    longest = max(len(w) for _, w in heads)
    found = []
    for d, path, text in rows:
        got, ws = (None, 0.0, False), licenses.words(text or "")
        if licenses.TRIGGER.search(text or ""):
            bare = weighed(licenses.words(licenses.OWNER.sub(" ", text)), [w for _, w in texts])
            best = max(((round(cosine(bare, weighed(w, [t for _, t in texts])), 9), k) for k, w in texts))
            if best[0] >= licenses.FULL:
                got = best[1], best[0], True
            else:
                near = [i for i in range(len(ws)) if any(w.startswith(licenses.LEADS) for w in ws[max(0, i - longest) : i + longest + 1])]
                every = [(round(cosine(weighed(ws[i : i + len(w)], [t for _, t in heads]), weighed(w, [t for _, t in heads])), 9), -i, len(w), k) for i in near for k, w in heads if ws[i] in w]
                top = max(every, key=lambda r: r[:3], default=(0.0, 0, 0, None))
                got = (top[3] if top[0] >= licenses.LEAST else None), top[0], False
        found.append((d, path or "", *got))
    files = {}
    for _, path, k, score, full in found:
        if k and (full or re.search(licenses.NAME, path.split("/")[-1])):
            files.setdefault(path.rpartition("/")[0], []).append((-round(score, 6), k))
    out = []
    for d, path, k, score, _ in found:
        at, origin = path.rpartition("/")[0], "own" if k else "none"
        while not k and origin == "none":
            if at in files:
                (minus, k), origin = min(files[at]), "inherited"
                score = -minus
            elif not at:
                break
            at = at.rpartition("/")[0]
        out.append((d, path, k, round(score, 5) if k else 0.0, origin))
    return out


def licensed(spark, rows):
    df = spark.createDataFrame([(*r, 0.5, "x", "d") for r in rows], "doc_id long, path string, text string, score double, own string, dir string")
    return [(r.doc_id, r.path, r.license, round(r.score, 5) if r.license else 0.0, r.origin) for r in licenses.licenses(df, F.col("path")).collect()]


def test_licenses(spark):
    got = licensed(spark, LICENSE_ROWS)
    assert sorted(map(str, got)) == sorted(map(str, plain_licenses(LICENSE_ROWS)))
    by = {(d, p): (k, o) for d, p, k, _, o in got}
    assert by[1, "a/LICENSE"] == ("MIT", "own") and by[4, "a/b/c/y"] == by[2, "a/b/x"] == ("Apache-2.0", "inherited") and by[5, "z/q"] == ("CC-BY-NC-4.0", "own") and by[6, "z/r"] == by[7, ""] == (None, "none")
    assert by[8, "a/k"] == ("GPL-3.0", "own") and by[9, "u/LICENSE"] == ("ISC", "own") and by[10, "u/v"] == ("ISC", "inherited") and by[12, "w/v/v"] == ("LGPL-2.1", "inherited") and by[13, "p/LICENSE"] == by[14, "p/x"] == (None, "none")
    assert by[16, "t/x"] == by[None, "t/y"] == ("CC-BY-4.0", "inherited") and by[17, "r/x"] == ("GPL-2.0", "own") and by[18, "r/x"] == ("GPL-3.0", "own") and by[19, "r/y"] == ("LGPL-3.0", "own") and by[20, "r/z"] == (None, "none")
    assert licensed(spark, []) == []


def test_licenses_on_documents_and_long_texts(spark):
    rows = [(r.doc_id, f"{r.source}/{r.doc_id}", r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10**6, "long/x", "license " * 30_000), (10**6 + 1, "long/y", "word " * 200_000 + "Released under the MIT License")]
    got = licensed(spark, rows)
    assert {r[0]: r[2:] for r in got if r[0] < 10**6} == {r[0]: r[2:] for r in plain_licenses(rows[:-2])}
    assert {r[0]: r[2] for r in got}[10**6] is None and {r[0]: r[2] for r in got}[10**6 + 1] == "MIT"


def whole(text):
    """What the tokenizer file itself says."""
    return len(reference_encoder(PATH).encode(text, add_special_tokens=False).ids)


def test_trees_equal_whole_counts():
    rng = np.random.default_rng(5)
    count = tokencount.Counter(PATH)
    signs = ["a", "b", "c", " ", " ", "\n", "\n", "\n", "'", "s", "t", "1", "é", ",", ".", "\t", " x", "<|endoftext|>", "<|endof", "text|>", "aaaaaaaaaaaaaaaa", "        ", "12345678", "!?!?!?!?"]
    part = lambda n: "".join(signs[k] for k in rng.integers(0, len(signs), n))
    for _ in range(150):
        tree = tokencount.Tree(part(rng.integers(0, 1500)), count)
        assert tree.total == whole(tree.text)
        for _ in range(6):
            a = int(rng.integers(0, len(tree.text) + 2))
            before = tree.text
            b, new = a + int(rng.integers(0, 40)), part(rng.integers(0, 30))
            tree.edit(a, b, new)
            assert tree.text == before[:a] + new + before[b:] and tree.total == whole(tree.text)
            assert all(p <= tokencount.LEAF for _, p, _ in tree.sizes()) and tree.root is None or tree.root.height <= 2 * len(tree.sizes()).bit_length() + 2


def test_edits_of_a_long_text_stay_local():
    rng = np.random.default_rng(6)
    words = [f"{w}{k}" for k in range(300) for w in ("the", "Haus", "niño", "x")]
    text = " ".join(words[k] for k in rng.integers(0, len(words), 60_000))
    tree = tokencount.Tree(text, tokencount.Counter(PATH))
    for _ in range(200):
        a = int(rng.integers(0, tree.root.chars))
        tree.edit(a, a + int(rng.integers(0, 12)), " new words here")
    assert tree.encoded < 200 * 6 * tokencount.LEAF and tree.total == whole(tree.text)
    sizes = tree.sizes()
    again = tokencount.Tree(tree.text, tree.count, sizes)
    assert again.total == tree.total and max(p for _, p, _ in sizes) <= tokencount.LEAF and tree.root.height <= 2 * len(sizes).bit_length()


def test_counts_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (9999, ""), (9998, "a<|endoftext|> b"), (9998, "a<|endoftext|> b")], "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = tokencount.counted(docs.withColumns({"leaves": F.lit(1), "n_tokens": F.lit("x"), "edits": F.lit(2)}), PATH).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = text[r.doc_id]
        n = len(t)
        assert r.n_tokens == whole(t)
        t = t[: n // 2] + " revised" + t[min(n // 2 + 7, n) :]
        t = "Note:\n" + t
        a, b = max(0, min(n - 9, len(t))), min(n + 1, len(t))
        t = t[:a] + t[max(a, b) :]
        assert r.n_after == whole(t) and (r.n_pieces < 4000 or r.n_encoded < r.n_pieces / 3)
    assert tokencount.counted(docs.limit(0), PATH).collect() == []


def test_edits_as_a_table(spark):
    rows = [(1, "one two three four"), (1, "another text of the same id"), (2, "never touched"), (None, "no id"), (3, None), (4, "word " * 5000)]
    edits = [(1, 2, 0, 3, "ONE"), (1, 1, 4, 7, "2"), (1, 2, 0, 3, "ONE"), (3, 1, 5, 2, "grown"), (3, 2, None, None, "!"), (4, 1, 10, 10**9, None), (None, 1, 0, 1, "x"), (77, 1, 0, 1, "x"), (4, None, 0, 0, "last ")]
    kept = tokencount.trees(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, edits string"), PATH)
    table = spark.createDataFrame(edits, "doc_id long, seq long, start long, end long, text string").repartition(5)
    got = tokencount.edited(kept, table, PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", "ONE 2 three four"), ("1", "ONEt2 text of the same id"), ("2", "never touched"), ("None", "no id"), ("3", "grown!"), ("4", "last word word ")])
    assert all(r.n_tokens == whole(r.text) and sum(x.tokens for x in r.leaves) == r.n_tokens and sum(x.chars for x in r.leaves) == len(r.text) for r in got)
    assert {r.doc_id: r.n_encoded for r in got}[2] == 0
    assert tokencount.edited(kept.limit(0), table, PATH).collect() == [] and tokencount.edited(kept, table.limit(0), PATH).count() == len(rows)


def test_whole_licence_files_grant(spark):
    wholes = licenses.whole_texts()
    text = {k: "Copyright (c) 2021 Somebody Else and others\n\n" + "\n".join(textwrap.wrap(t, 66)) for k, t in wholes.items()}
    rows = [x for k in wholes for x in ((1, f"{k}/x/LICENSE-file", text[k]), (2, f"{k}/y/terms", text[k].replace("the", "the ", 3)), (3, f"{k}/x/a/b", "plain"), (4, f"{k}/y/c", "plain"), (5, f"{k}/z", "plain"))]
    rows += [(90, "n/COPYING", "Licensed under CC BY 4.0.\n" + "other words " * 60), (91, "n/a", "plain"), (92, "o/readme", "Licensed under CC BY 4.0.\n" + "other words " * 60), (93, "o/a", "plain"), (94, "m/LICENSE", text["MIT"][:700] + " and other terms of our own that nobody has read " * 20)]
    got = {r.path: (r.license, r.origin) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    for k in wholes:
        assert [got[f"{k}/{p}"] for p in ("x/LICENSE-file", "y/terms", "x/a/b", "y/c", "z")] == [(k, "own"), (k, "own"), (k, "inherited"), (k, "inherited"), (None, "none")]
    assert got["n/a"] == ("CC-BY-4.0", "inherited") and got["o/a"] == (None, "none") and got["m/LICENSE"] == ("MIT", "own")


def test_quoted_line_repeated_in_an_earlier_conversation(spark):
    rows = [(1, 0, "user", "> The sky is often blue here.\nThe sky is often blue here."), (2, 3, "user", "The sky is often blue here."), (3, 1, "user", "The sky is often blue here.")]
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): (2, 3), (2, 3): (None, None), (3, 1): (None, None)}
