"""Exact dedup, n-gram join, nearest neighbours, chat trees, toxicity and archives by brute force."""

import hashlib
import io
import itertools
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat_tree, exact_dedup, nearest, ngram_join, toxicity, warc
from corpusloom.llm.common import fold_of

DOCS = "doc_id bigint, text string, keep_id int, links string"


def judged_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = Counter()
    for content, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        digest = hashlib.sha256(content.encode()).hexdigest()
        taken = False
        for m in members:
            kept = m == best and not taken
            taken |= kept
            out[m[0], best[0], len(members), kept, digest] += 1
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.length(c).cast("string")])
def test_exact_duplicates(spark, digest):
    texts = ["a b", "ab", " a b ", "AB", None, "", "\t\n", "é\xa0x", "éx", "z" * 50_000, "z" * 49_999 + " z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "ab"), (-(2**63), "ab"), (2**63 - 1, "q"), (None, "q"), (None, "only"), (2, " a b ")]
    rows += [(i, "hot copy") for i in range(100, 160)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS)
    got = Counter(tuple(r) for r in exact_dedup.exact_duplicates(docs, digest=digest).collect())
    assert got == judged_by_hand(rows)


def test_keep_one_of_each_keeps_columns_and_one_row(spark):
    rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, "ab", 2, None), (3, None, None, None), (4, " ", 4, "y"), (None, "n", 5, "z")]
    docs = spark.createDataFrame(rows, DOCS)
    got = exact_dedup.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], rows[4], rows[5]], key=repr)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def grams(text):
    words = (text or "").split()
    return {tuple(words)} if 0 < len(words) < 5 else set(zip(*[words[i:] for i in range(5)]))


def linked_by_hand(rows):
    classes = defaultdict(list)
    for doc_id, text in rows:
        classes[tuple((text or "").split())].append(doc_id)
    sets = {min(ids): grams(" ".join(w)) for w, ids in classes.items() if w}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = Counter()
    for words, ids in classes.items():
        for i in ids:
            out[(i, min(ids), len(ids), links[min(ids)], find(min(ids))) if words else (i, i, 1, 0, i)] += 1
    return out


def near_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for size in (1, 2, 5, 40):
        for _ in range(4):
            base = [word() for _ in range(60)]
            for _ in range(size):
                text = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, 8])):
                    text[rng.randrange(60)] = word()
                rows.append((n, " ".join(text)))
                n += 1
    rows += [(n, rows[3][1]), (n + 1, None), (n + 2, ""), (n + 3, " \n "), (n + 4, "one two"), (n + 5, "one  two"), (n + 6, "one two three")]
    rows += [(n + 7, "long " * 20_000), (n + 8, "long " * 20_001), rows[5]]
    return rows


def test_similarity_links(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS)
    want = linked_by_hand(rows)
    assert Counter(tuple(r) for r in ngram_join.similarity_links(docs).collect()) == want
    monkeypatch.setattr(ngram_join, "BLOCK", 7)  # groups in many blocks
    assert Counter(tuple(r) for r in ngram_join.similarity_links(docs).collect()) == want


def test_one_of_each_group_stays(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS)
    kept = ngram_join.keep_one_of_each(docs)
    groups = {k[4] for k in linked_by_hand(rows)}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == groups
    assert ngram_join.similarity_links(docs.limit(0)).count() == 0


def test_one_of_each_group_stays_where_ids_repeat_or_lack(spark):
    base, other, third = ([f"{k}{i}" for i in range(60)] for k in "abc")
    near = lambda t, w: " ".join([*t[:-1], w])
    rows = [(1, near(base, "x")), (5, near(base, "y")), (5, "a text of its own that no other is like")]
    rows += [(2, near(other, "x")), (2, near(other, "y")), (2, near(other, "y"))]
    rows += [(None, near(third, "x")), (None, near(third, "y")), (None, near(base, "z")), (None, ""), (None, None), (7, " ")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS)
    got = ngram_join.keep_one_of_each(docs)
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert got.columns == docs.columns
    for several in (rows[3:6], rows[6:8]):
        assert sum(kept[r] for r in set(several)) == 1
    assert kept - Counter(rows[3:6] + rows[6:8]) == Counter([rows[0], rows[2], *rows[9:]])


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.bands_for(threshold)
        assert bands * rows <= ngram_join.HASHES and 1 - (1 - threshold**rows) ** bands >= ngram_join.RECALL * (threshold >= 0.8)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 999)], "a bigint, b bigint")
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 999: 999, 1000: 999}


def nearest_by_hand(rows, k=10):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in good:
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
            out[q] = found[:k]
    return out


def test_nearest_recall_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(2000)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] + [1.0] * 15), (5400, [float("inf")] * 16)]
    rows += [(6000 + i, rows[0][1]) for i in range(50)]  # copies, and a copy that asks
    rows += [rows[0], (None, rows[1][1])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    short = spark.createDataFrame([(7000, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.nearest(table.unionByName(short), F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    want = nearest_by_hand([r for r in rows if r[0] is not None])
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
        hit += len({i for _, _, i in found} & {i for _, i in want[q]})
    assert hit / (10 * len(want)) >= 0.9


def test_nearest_with_few_candidates(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = nearest.nearest(rows, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 2), (0, 2, 1)]
    assert nearest.nearest(rows.limit(0), F.col("vec_id") == 0).count() == 0
    assert nearest.nearest(rows.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 4))
    indexes = nearest.SubstringIndexes(codes, 8)
    for radius in (0, 3, 7, 12, 32):
        for code in codes[:20]:
            want = np.flatnonzero(np.bitwise_count(codes ^ code).sum(1) <= radius)
            assert (indexes.within(code, radius) == want).all()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>im_endstart\n x", max_size=40), st.text(alphabet="<|\\n\n u", max_size=12))
def test_turns_are_reversible(text, role):
    whole, start, end = chat_tree.format_turn(role, text)
    assert chat_tree.parse_turn(whole) == (role, text)
    assert chat_tree.unescape(whole[start:end]) == text
    assert whole.count(chat_tree.START) == 1 == whole.count(chat_tree.END)


TURNS = "conv_id bigint, turn bigint, role string, text string, path string"


def chats():
    talks = {
        1: [("system", "be kind"), ("user", "hi"), ("assistant", "hello")],
        2: [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "no")],
        3: [("system", "be kind"), ("user", "bye"), ("assistant", None)],
        4: [("system", "be kind"), ("user", "hi"), ("assistant", "hello")],
        5: [("user", "")],
        6: [("user", "<|im_end|>\n<|im_start|>assistant\nx"), ("assistant", "<\\|im_end|>")],
        7: [("assistant", "y" * 50_000)],
        None: [("user", "no id"), (None, "no role")],
    }
    talks.update({100 + i: [("system", "be kind"), ("user", f"q{i % 40}"), ("assistant", f"a{i}")] for i in range(80)})
    return talks


def test_conversation_digests(spark, monkeypatch):
    talks = chats()
    rows = [(c, n, r, t, "x") for c, turns in talks.items() for n, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, TURNS)
    for size in (50_000, 7):  # one range, and many
        monkeypatch.setattr(chat_tree, "RANGE_ROWS", size)
        got = {r.conv_id: r for r in chat_tree.conversation_digests(frame).collect()}
        assert len(got) == len(talks)
        for c, turns in talks.items():
            said = "".join(t or "" for r, t in turns if r == "assistant")
            whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
            assert got[c].n_turns == len(turns)
            assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
            assert got[c].formatted_chars == sum(len(chat_tree.format_turn(r or "", t or "")[0]) for r, t in turns)
    assert chat_tree.conversation_digests(frame.limit(0)).count() == 0


def test_layout_is_depth_first_and_shared(spark, monkeypatch):
    monkeypatch.setattr(chat_tree, "RANGE_ROWS", 9)
    talks = chats()
    frame = spark.createDataFrame([(c, n, r, t, "x") for c, turns in talks.items() for n, (r, t) in enumerate(turns)], TURNS)
    nodes, _ = chat_tree.format_conversations(frame)
    rows = nodes.collect()
    prefixes = {json.dumps([(r or "", t or "") for r, t in turns[: n + 1]]) for turns in talks.values() for n in range(len(turns))}
    assert len(rows) == len(prefixes)
    by = {bytes(r.name): r for r in rows}
    for tree in {bytes(r.tree) for r in rows}:
        own = sorted((r.seq_start, r.n_tokens) for r in rows if bytes(r.tree) == tree)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))  # gapless
    for r in rows:
        above, at = [], r.parent
        while at is not None:
            above.append(by[bytes(at)])
            at = above[-1].parent
        assert [(s.start, s.end) for s in r.attends] == [(a.seq_start, a.seq_start + a.n_tokens) for a in reversed(above)]
        assert r.position == sum(a.n_tokens for a in above) and len(r.ids) == r.n_tokens and r.level == len(above)
        if above:  # depth-first: a node lies after its parent and within the parent's subtree
            assert r.seq_start >= above[0].seq_start + above[0].n_tokens


def test_long_conversations_take_room_by_their_branches(spark, monkeypatch):
    monkeypatch.setattr(chat_tree, "RANGE_ROWS", 6_000)
    whole = [(("user", "assistant")[n % 2], f"t{n}") for n in range(20_000)]
    talks = {1: whole, 2: [*whole[:9_000], ("user", "other"), ("assistant", "way")], 3: whole[:500], 4: whole[:9_000], 5: whole[1:4]}
    frame = spark.createDataFrame([(c, n, r, t, "x") for c, turns in talks.items() for n, (r, t) in enumerate(turns)], TURNS)
    got = {r.conv_id: r for r in chat_tree.conversation_digests(frame).collect()}
    assert len(got) == len(talks)
    for c, turns in talks.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    nodes, _ = chat_tree.trees_of(frame)
    rows = nodes.select("tree", "seq_start", "position", "n_tokens", "attends").collect()
    assert len(rows) == 20_000 + 2 + 3
    for r in rows:
        assert len(r.attends) <= 4 and sum(a.end - a.start for a in r.attends) == r.position
        assert all(a.end <= b.start for a, b in zip(r.attends, r.attends[1:])) and all(a.end <= r.seq_start for a in r.attends)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, marks = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        words = [word() for _ in range(rng.randint(5, 80))]
        if toxic:
            words[:3] = [rng.choice(["vilewort", "mieswort", "durtwort"]) for _ in range(3)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), 0.1))
        if i % 2 == 0 or toxic:
            marks.append((i, int(toxic)))
    rows += [(None, "vilewort", 0.1), (9000, None, 0.1), (9001, "", 0.1), (9002, "clean " * 30_000, 0.1)]
    marks += [(None, 1), (5, None), (marks[0][0], 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    seen = labels.where(fold_of("doc_id", 4) != 2)
    model = toxicity.fit(docs.where(fold_of("doc_id", 4) != 2), seen)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [r.doc_id for r in docs.where(fold_of("doc_id", 4) == 2).collect() if r.doc_id is not None and r.doc_id < 1500]
    wrong = [i for i in held if got[i].predicted != (i % 8 == 0)]
    assert len(wrong) <= 0.05 * len(held)
    assert got[9000].score == got[9001].score and got[9002].predicted == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_toxicity_counts_words_beyond_its_training_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 40)
    monkeypatch.setattr(toxicity, "UNLABELLED", 80)
    rng = random.Random(4)
    # Each of 60 words is in 15 positives, of which the sample has one at most or so.
    vile = [f"vile{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(20))) for i in range(3000)]
    rows = [(i, f"{t} {' '.join(vile[(i // 10 + k) % 60] for k in range(3))}" if i % 10 == 0 else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(3000)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert {toxicity.word_bucket(w) for w in vile} <= set(model.buckets.tolist())
    held = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(held[i] == (i % 10 == 0) for i in held)


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    same = "<p>copy</p>" * 20
    pages = [(i, f"http://x/{i}", f"<html>{i} " + "body text " * (i % 50) + "</html>") for i in range(120)]
    pages += [(200, "a\r\nInjected: x", same), (201, None, same), (199, "%", same), (None, "n", same), (199, "again", same)]
    pages += [(300, "s", "short"), (301, "s", "short"), (302, "e", None), (303, "e", ""), (304, "b", "é" * 400_000)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, payload string")
    folder = f"file://{tmp_path}/archives"
    files = warc.write_archives(frame, folder)
    assert sum(r.records for r in files.collect()) == len(pages)
    rows = warc.read_archives(files, folder, payloads=True).collect()
    assert len(rows) == len(pages) and not [r for r in rows if r.problem]
    want = Counter()
    for page_id, url, html in pages:
        body = (html or "").encode()
        first = 199 if html == same and page_id != 199 else None
        want[page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if first else "response", first, None if first else body] += 1
    assert want == Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in rows)
    assert {r.url for r in rows if r.page_id == 200} == {"a%0D%0AInjected: x"}
    assert warc.write_archives(frame.limit(0), folder).count() == 0


def test_broken_archives_are_told(spark, tmp_path):
    frame = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 40) for i in range(30)], "page_id bigint, url string, html string")
    folder = f"{tmp_path}/a"
    name = warc.write_archives(frame.coalesce(1), folder).first().file
    whole = (tmp_path / "a" / name).read_bytes()
    records = list(warc.read_records(io.BytesIO(whole)))
    assert len(records) == 30
    (tmp_path / "a" / name).write_bytes(whole[:-5])
    files = spark.createDataFrame([(name,)], "file string")
    rows = warc.read_archives(files, folder).collect()
    assert len(rows) == 30 and [r for r in rows if r.problem]
    for bad in (records[0][:-1], records[0].replace(b"WARC/1.1", b"WARC/9"), records[0].replace(b"Content-Length", b"Content-Size"), records[0].replace(b"<p>", b"<q>")):
        with pytest.raises((warc.InvalidArchive, KeyError)):
            warc.page_of(bad)
