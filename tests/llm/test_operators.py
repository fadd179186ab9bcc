"""The operators against brute force, exact round trips and edge cases, on small fixtures."""

import base64
import email.parser
import email.policy
import gzip
import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from skeinflow.llm import bpe, chat, embedding_dedup, kernels, mixing, quality_classifier, quality_rules, substring_dedup, toxicity, warc
from skeinflow.llm.components import components
from skeinflow.llm.minhash_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, d1 long, bands string, everything string, size long, rep long, t1 long"


def docs(spark, texts, sources=None, ids=None):
    """Documents with extra columns whose names clash with those that the operators make."""
    rows = [(i if ids is None else ids[i], t, None if i % 7 == 3 else "en", (sources or [None])[i % len(sources or [None])], len(t or ""), 1, "b", "e", 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups".split()) + str(rng.randint(0, 40)) for _ in range(n))


ODD = [None, "", " \t\n", "one", "a b c d", "A B C D", "é à ü", "x" * 5000, "same words " * 200, "same words " * 200, "\x00 nul\x1f unit", "  lead and trail  ", "a\nb\n\na\n"]


# --- kernels


def test_words_and_hashes():
    col = pa.array(["a bb  c\n", None, "", " x", "é b c", "a bb"])
    got = []
    for t in kernels.texts(col, limit=4):
        w = kernels.words(t)
        h = kernels.span_hashes(t.data, w.start, w.end)
        for i in range(t.hi - t.lo):
            got.append([(bytes(t.data[a:b]).decode(), x) for a, b, x in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], h[w.first[i] : w.first[i + 1]], strict=True)])
    assert [[x[0] for x in g] for g in got] == [["a", "bb", "c"], [], [], ["x"], ["é b", "c"], ["a", "bb"]]
    assert got[0][0] == got[5][0] and got[0][1] == got[5][1] and got[0][0][1] != got[0][2][1]


# --- op1


def test_templates():
    run = lambda s, **c: "".join(p for p, _ in chat.compile_template(s)(c))
    assert run("{% for x in xs %}{{ x.a }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"a": 1}, {"a": 2}]) == "1, 2"
    assert run("{% if a == 1 and b %}x{% elif a %}y{% else %}z{% endif %}", a=2) == "y"
    assert run("{% set q = 'a' ~ 1 %}{{ q | upper }}{{ xs[1] }}", xs=[4, 5]) == "A15"
    assert chat.fold(chat.parse("{% if 1 == 1 %}a{% else %}b{% endif %}c{{ 'd' }}")) == [("text", "acd")]
    assert list(chat.compile_template("a{% generation %}{{ x }}{% endgeneration %}")({"x": "y"})) == [("a", False), ("y", True)]
    for bad in ("{% for %}", "{{ a( }}", "{% if a %}", "{{ x.__class__() }}", "{{ x|nofilter }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for text in ("</s>[INST] ok [/INST]", "\\l\\b<[\\", "plain"):
        assert chat.unescape(chat.escape(text)) == text and not set("<[") & set(chat.escape(text))


def test_chat_round_trip(spark):
    turns = [(1, 1, "assistant", "b</s> [INST]"), (1, 0, "user", "a\\b"), (2, 0, None, None), (2, 1, "too[l", "x\ny"), (None, 0, "user", "n"), (-7, 0, "user", chat.EXTRA[0][3]), (-7, 1, "assistant", chat.EXTRA[1][3]), (9, 0, "user", "")]
    turns += [(5, i, ("user", "assistant")[i % 2], "long " * 4000 + str(i)) for i in range(12)]
    df = spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, part string")
    parts = chat.format_conversations(df)
    assert parts.where("conv_id = 5").count() > 1
    got = {r.conv_id: r for r in chat.read_back(parts).collect()}
    want = defaultdict(list)
    for c, n, role, text in sorted(turns, key=lambda t: (str(t[0]), t[1])):
        want[c].append((role or "", text or ""))
    assert set(got) == set(want)
    for c, ts in want.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        assert got[c].n_turns == len(ts) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


# --- op2, op8


def labelled(spark, n, mark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(40, 120)).split()
        y = i % 4 == 0
        if y:
            mark(words, rng)
        rows.append(" ".join(words))
        labels.append((i, 0 if y else 1, 1 if y else 0))
    return docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (4, 9, 9)], "doc_id long, quality int, toxic int")


def test_quality_classifier(spark):
    def spam(words, rng):
        words[:] = [w + rng.choice(["***", "$$$"]) for w in words]

    d, labels = labelled(spark, 400, spam)
    d = d.union(docs(spark, ODD, ids=[None, *range(1000, 1000 + len(ODD) - 1)]))
    got = quality_classifier.quality_scores(d, labels).collect()
    assert len(got) == 400 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and np.mean([(r.doc_id % 4 != 0) == (r.predicted == 1) for r in held]) > 0.95
    none = quality_classifier.quality_scores(d, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.quality_scores(d.where("false"), labels).count() == 0


def test_toxicity(spark):
    def insult(words, rng):
        for _ in range(2):
            words[rng.randrange(len(words))] = rng.choice(["idiot,", "Scum", "moron."])

    d, labels = labelled(spark, 600, insult)
    d = d.union(docs(spark, ODD, ids=[None, *range(1000, 1000 + len(ODD) - 1)]))
    got = toxicity.toxicity(d, labels).collect()
    assert len(got) == 600 + len(ODD)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and np.mean([(r.doc_id % 4 == 0) == (r.predicted == 1) for r in held]) > 0.95
    assert all(r.score == 0.5 for r in toxicity.toxicity(d, labels.where("false")).collect())
    at, w = toxicity.fit(labels.join(d, "doc_id").select(F.lit(1).alias("place"), F.col("toxic").alias("label"), "text").where("label in (0, 1)"))
    assert 0 < len(at) // 4 < 2000


# --- op3


def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        left = total - sum(fixed.values())
        heft = sum(weight[n] for n in free)
        share = {n: left * weight[n] / heft for n in free}
        over = [n for n in free if share[n] > 2 * sizes[n]]
        if not over:
            return {**fixed, **share}
        fixed |= {n: 2.0 * sizes[n] for n in over}


def test_mixing(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(900)] + ODD
    sources = ["b", "a", "a", "c", None, "Z", "a", "é"]
    d = docs(spark, texts, sources)
    got = mixing.mix(d).collect()
    again = mixing.mix(d.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(texts)
    sizes, taken, target = Counter(), Counter(), {}
    of = dict(enumerate(sources[i % len(sources)] for i in range(len(texts))))
    for r in got:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        sizes[of[r.doc_id]] += r.size
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.03 * want[s] + 3
    mixed = mixing.mix_documents(d)
    assert mixed.columns == d.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert dict(words) == {r.doc_id: r.taken for r in got if r.taken}
    assert mixing.mix(d.where("false")).count() == 0 and mixing.mix_documents(d.where("false")).count() == 0


def test_apportionment_matches_brute_force(spark):
    rng = random.Random(3)
    for n, seats in ((1, 7), (3, 10), (5, 97), (9, 4), (4, 0)):
        w = [rng.choice([0, 1, 3, 7, 50, 400]) for _ in range(n)]
        df = spark.createDataFrame([(i, float(x), seats) for i, x in enumerate(w)], "i int, w double, s long")
        got = {r.i: r.quota for r in mixing.apportion(df, [], "i", "w", "s").collect()}
        quotients = sorted(((-x / (2 * k - 1), i, k) for i, x in enumerate(w) if x for k in range(1, seats + 1)))[:seats]
        want = Counter(q[1] for q in quotients)
        assert got == {i: want[i] for i in range(n)}


# --- op4


def brute_links(rows):
    """(vec_id, n_links, component_id, kept) of each row, rows being the nodes."""
    ok = [k for k, (i, v, y) in enumerate(rows) if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = Counter(), list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, a in enumerate(ok):
        for b in ok[:n]:
            u, v = np.array(rows[a][1]), np.array(rows[b][1])
            if rows[a][2] == rows[b][2] and len(u) == len(v):
                u, v = u / np.abs(u).max(), v / np.abs(v).max()
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, links[k], None if i is None else least[find(k)], i is None or least[find(k)] == i) for k, (i, _, _) in enumerate(rows))


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 1, [1]) for r in rows], "vec_id long, embedding array<double>, label int, unit string, n int, cls int, keys array<int>")


def found_links(df, *levels):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, *levels).collect())


_LEVEL = [x for _, x in embedding_dedup.LEVELS]


@pytest.mark.parametrize("levels", [[(float("inf"), _LEVEL[0])], [(110, _LEVEL[1]), (float("inf"), _LEVEL[2])], [(float("inf"), _LEVEL[3])]])
def test_embeddings(spark, levels):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    vectors = [base[i % 60] + rng.normal(size=16) * (0.0 if i < 60 else 0.1) for i in range(200)]
    rows = [(i, v.tolist(), int(i % 60 % 2)) for i, v in enumerate(vectors)] + [(300 + i, vectors[0].tolist(), 0) for i in range(40)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16]
    rows += [(400 + i, v, 0) for i, v in enumerate(bad)] + [(500, vectors[0].tolist(), None), (None, vectors[0].tolist(), 0), (501, vectors[0].tolist()[:8], 0), (502, (np.array(vectors[0]) * 1e-300).tolist(), 0)]
    df = vectors_of(spark, rows)
    assert found_links(df, levels) == brute_links(rows)


def test_embeddings_with_repeated_ids(spark):
    rng = np.random.default_rng(2)
    e, f = np.eye(8)[0], np.eye(8)[1]
    near = e + 0.05 * f
    rows = [(1, e, 0), (1, e, 1), (2, e, 0), (3, e, 1), (4, near, 0), (5, f, 0), (5, near, 0), (6, f, 0), (7, f, 1), (7, f, 1), (7, e, 1)]
    rows += [(10, e + 2 * np.eye(8)[7], 0), (10, f + 2 * np.eye(8)[7], 0)]
    rows = [(i, v.tolist(), y) for i, v, y in rows]
    wide = [(20 + i % 9, (np.eye(8)[i % 3] + rng.normal(size=8) * 0.08).tolist(), 2 + i % 2) for i in range(60)]
    for some in ([*rows, *wide], []):
        assert found_links(vectors_of(spark, some)) == brute_links(some)


def test_embeddings_in_blocks(spark, monkeypatch):
    """One bucket of many blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=12)
    rows = [(i, (base + rng.normal(size=12) * 0.15).tolist(), 0) for i in range(120)]
    assert found_links(vectors_of(spark, rows)) == brute_links(rows)


def test_lattice():
    m = embedding_dedup.minimal_vectors()
    assert m.shape == (240, 8) and np.allclose((m**2).sum(axis=1), 2)
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    p = embedding_dedup.decode(x)
    assert np.allclose(embedding_dedup.decode(p), p)
    d = ((x - p) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all() and all((((x[i] - p[i] - m) ** 2).sum(axis=1) >= d[i] - 1e-9).all() for i in range(300))


@pytest.mark.parametrize("dim", [4, 16, 64, 256])
@pytest.mark.parametrize("level", [x for _, x in embedding_dedup.LEVELS])
def test_lattice_recall(dim, level):
    """Pairs whose cosine is the bound exactly meet, and unlike ones seldom."""
    rng = np.random.default_rng(3)
    u = embedding_dedup.unit_rows(rng.normal(size=(500, dim)))
    w = rng.normal(size=u.shape)
    w = embedding_dedup.unit_rows(w - (w * u).sum(axis=1, keepdims=True) * u)
    v = 0.93 * u + (1 - 0.93**2) ** 0.5 * w
    a, b = (embedding_dedup.cells(z, np.zeros(500, int), level) for z in (u, v))

    def met(a, b):
        return ((a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)).any(axis=1).mean()

    assert met(a, b) >= 0.97
    if dim >= 64:
        assert met(a, np.roll(a, 1, axis=0)) <= 0.02
    other = embedding_dedup.cells(u, np.ones(500, int), level)
    assert not (a == other).any()


# --- op5


def brute_repeats(texts):
    where = defaultdict(list)
    words = [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 34):
            where[tuple(w[k : k + 35])].append((i, k))
    gone = [set() for _ in texts]
    for at in where.values():
        if len(at) > 1:
            for i, k in at:
                gone[i].update(range(k, k + 35))
    return [(len(w), len(g), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in g).encode()).hexdigest()) for w, g in zip(words, gone, strict=True)]


def test_substrings(spark):
    rng = random.Random(5)
    passage, short = prose(rng, 60), prose(rng, 34)
    texts = [prose(rng, 100) for _ in range(6)]
    texts += [prose(rng, 30) + " " + passage + "\n" + prose(rng, 20) for _ in range(5)] + [passage, f"x {short} y", f"z {short} w", texts[0], texts[0], prose(rng, 40) * 1]
    texts += ["w " * 80, "w " * 30, (passage + " ") * 3, *ODD]
    ids = [None if i == 2 else 7 if i in (3, 4) else i for i in range(len(texts))]
    d = docs(spark, texts, ids=ids)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(d).collect())
    assert got == Counter((i, *x) for i, x in zip(ids, brute_repeats(texts), strict=True))
    kept = substring_dedup.strip_repeats(d)
    assert kept.columns == d.columns
    left = [x for x in brute_repeats(texts) if x[0] > x[1]]
    assert sorted(hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() for r in kept.collect()) == sorted(x[2] for x in left)
    assert substring_dedup.remove_repeats(d.where("false")).count() == 0


def test_index_runs_and_compaction(spark, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"))
    batch = lambda *xs: spark.createDataFrame([(x, 1) for x in xs], "fp long, n int")
    assert index.add(batch(1, 2, 3)).count() == 0 and [t for _, t in index.runs] == [0]
    assert {r.fp for r in index.add(batch(3, 4, 4)).collect()} == {3, 4} and [t for _, t in index.runs] == [1]
    again = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"))
    assert again.runs == index.runs and {r.fp: r.n for r in again.run(again.runs[0][0]).collect()} == {1: 1, 2: 1, 3: 2, 4: 2}
    assert {r.fp for r in again.add(batch(2, 9)).collect()} == {2} and [t for _, t in again.runs] == [1, 0]
    assert again.add(batch(7)).count() == 0 and [t for _, t in again.runs] == [2]
    with pytest.raises(RuntimeError):
        index._commit()  # a writer that has not seen the later versions
    again.drop()
    assert not (tmp_path / "index").exists()


def test_repeats_of_an_earlier_day(spark, tmp_path):
    """Day 2 finds what day 1 holds after the index is opened anew, by another session."""
    rng = random.Random(15)
    passage, whole, own = prose(rng, 50), prose(rng, 60), prose(rng, 45)
    near = passage.split()[:34] + ["other"]  # shares an anchor with the passage, and no window
    days = [
        [prose(rng, 40) + " " + passage + " " + prose(rng, 10), whole, prose(rng, 80), None],
        [prose(rng, 15) + " " + passage + " " + prose(rng, 30), whole, prose(rng, 70), own + " x " + own, " ".join(near) + " " + prose(rng, 20), "", None],
        [passage, own, prose(rng, 50)],
    ]
    for day, texts in enumerate(days):
        session = spark if day == 0 else spark.newSession()
        index = substring_dedup.FingerprintIndex(session, str(tmp_path / "history"))
        d = session.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(d, index).collect()}
        past = [t for earlier in days[:day] for t in earlier]
        assert got == {f"id{i}": x for i, x in enumerate(brute_repeats([*texts, *past])[: len(texts)])}
        assert day == 0 or any(r for _, r, _ in got.values())


# --- op6


def test_warc(spark, tmp_path):
    html = '<html><head><title>T &amp; t</title><script>no</script></head><body><p>One <b>two</b></p><!-- c --><a href="/x">li&eacute;n</a></body></html>'
    rows = [(1, "http://a/b", html, 0), (2, None, None, 0), (3, "http://c", "", 0), (4, "http://d", "<p>" * 3000 + "x" * 100_000, 0), (5, "http://a/b", "plain < text & more\n", 0), (1, "http://a/b", html, 0), (None, "u\r\nWARC-Type: x", "é", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, metadata int")
    got = warc.page_derivatives(pages).collect()
    assert len(got) == len(rows)
    r = next(x for x in got if x.page_id == 1)
    assert (r.title, r.n_outlinks, r.target_uri, r.http_status) == ("T & t", 1, "http://a/b", "HTTP/1.1 200 OK")
    assert r.text_sha256 == hashlib.sha256("One two\nlién".encode()).hexdigest() and r.refers_to == r.conversion_refers_to
    assert r.source_payload_digest == warc.digest(html.encode())
    source = warc.page_response(1, "http://a/b", html)
    assert r.refers_to == source.get("WARC-Record-ID") and list(warc.parse(warc.serialise(source) * 2)) == [source, source]
    out = str(tmp_path / "warc")
    warc.write_warc(warc.page_responses(pages), out)
    back = warc.read_warc(spark, out)
    assert back.count() == len(rows) and {x.type for x in back.collect()} == {"response"}
    for cut in (warc.serialise(source, compress=False)[:-200], warc.serialise(source)[:-9]):
        with pytest.raises(ValueError):
            list(warc.parse(cut))
    assert list(warc.parse(warc.serialise(source) + b"\0" * 512)) == [source]
    assert warc.page_derivatives(pages.where("false")).count() == 0
    text_ids = pages.withColumn("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")))
    assert {x.page_id for x in warc.page_derivatives(text_ids).collect()} == {None, "p1", "p2", "p3", "p4", "p5"}


def stdlib_record(data):
    """Headers and block of one gzip member by the standard library's readers."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    fields = email.parser.BytesParser(policy=email.policy.compat32).parsebytes(lines + b"\r\n\r\n")
    n = int(fields["Content-Length"])
    assert version == b"WARC/1.1" and rest[n:] == b"\r\n\r\n"
    return fields, rest[:n]


def test_warc_by_another_reader(spark):
    """The records of the derivatives as the standard library reads them, and ids and digests as DuckDB and uuid5 make them."""
    html = "<title>A</title><p>été <a href='/1'>x</a><a href='/2'>y</a>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", html + str(i)) for i in range(5)], "page_id long, url string, html string")
    responses = warc.page_responses(pages)
    for r in warc.derivatives(responses).join(responses, "page_id").collect():
        source, block = stdlib_record(bytes(r.warc))
        payload = block.split(b"\r\n\r\n", 1)[1]
        assert payload == (html + str(r.page_id)).encode()
        sha = lambda x: "sha1:" + base64.b32encode(bytes.fromhex(duckdb.execute("SELECT sha1(?)", [x]).fetchone()[0])).decode()
        assert source["WARC-Payload-Digest"] == sha(payload) and source["WARC-Block-Digest"] == sha(block)
        name = "\0".join(["response", str(r.page_id), f"http://h/{r.page_id}", sha(payload)])
        assert source["WARC-Record-ID"] == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
        for data, kind in ((r.metadata, "metadata"), (r.conversion, "conversion")):
            fields, block = stdlib_record(bytes(data))
            assert fields["WARC-Type"] == kind and fields["WARC-Block-Digest"] == sha(block)
            assert fields["WARC-Refers-To"] == source["WARC-Record-ID"] and fields["WARC-Refers-To-Target-URI"] == source["WARC-Target-URI"] == f"http://h/{r.page_id}"
            assert fields["WARC-Refers-To-Date"] == source["WARC-Date"] and fields["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"]
            if kind == "conversion":
                assert block.decode() == f"été xy{r.page_id}"
            else:
                notes = email.parser.BytesParser().parsebytes(block)
                assert notes["title"] == "A" and notes.get_all("outlink") == ["/1", "/2"] and notes["http-header-content-type"] == "text/html; charset=utf-8"
                assert int(notes["source-payload-length"]) == len(payload) and notes["source-block-digest"] == source["WARC-Block-Digest"]


def test_bodies_of_crawls():
    html = "<p>hello" + " wörld" * 50
    raw = html.encode()
    squeezed = zlib.compressobj(6, zlib.DEFLATED, -15)
    chunks = lambda x: b"".join(b"%x;e=1\r\n%s\r\n" % (len(x[i : i + 7]), x[i : i + 7]) for i in range(0, len(x), 7)) + b"0\r\nTrailer: t\r\n\r\n"
    cases = [
        ("", raw), ("Content-Encoding: gzip", gzip.compress(raw)), ("Content-Encoding: gzip", gzip.compress(raw[:40]) + gzip.compress(raw[40:])), ("Content-Encoding: deflate", zlib.compress(raw)),
        ("Content-Encoding: deflate", squeezed.compress(raw) + squeezed.flush()), ("Transfer-Encoding: chunked", chunks(raw)), ("Transfer-Encoding: chunked\r\nContent-Encoding: x-gzip", chunks(gzip.compress(raw))),
        ("Content-Encoding: gzip", raw), ("Transfer-Encoding: chunked", raw), ("Content-Encoding: deflate, gzip", gzip.compress(zlib.compress(raw))), ("Content-Encoding: identity", raw),
    ]
    for head, payload in cases:
        block = b"HTTP/1.1 200 OK\r\n" + (head + "\r\n").lstrip().encode() + b"Content-Type: text/html\r\n\r\n" + payload
        metadata, conversion = warc.derive(warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], block))
        assert conversion.block.decode() == "hello" + " wörld" * 50, head
        assert warc.digest(payload) in metadata.block.decode()
    cut = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(raw)[:-12]
    assert warc.derive(warc.Record([], cut))[1].block.startswith(b"hello")
    brotli = warc.derive(warc.Record([], b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\n\x8b\x00"))
    assert brotli[1].block == b"" and b"undecoded-content-encoding: br" in brotli[0].block
    for page, text in (("<p>a<template><p>b", "a\nb"), ("<p>a<template><p>b</template>c", "a\nc"), ("<noscript>x<p>y", "x\ny"), ("<head><meta><p>z", "z"), ("<head><style>p{}</style><body>q", "q"), ("<p>a<script>var b", "a")):
        assert warc.html_text(page)[0] == text, page


def test_pages_in_one_pass(spark):
    """Records don't travel between workers on the way from pages to summaries, and say what the three steps say one by one."""
    rows = [(i, f"http://h/{i}", f"<title>t{i}</title><p>a<br>b<a href='/{i}'>" + "c " * i) for i in range(300)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.page_derivatives(pages)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = warc.summaries(warc.derivatives(warc.page_responses(pages)))
    assert got.schema == apart.schema and sorted(got.collect(), key=str) == sorted(apart.collect(), key=str) and got.count() == 301


def test_short_way_through_html():
    """The short way through common tags gives what the library's parser gives by itself."""

    class Plain(warc._Text):
        goahead, updatepos = HTMLParser.goahead, HTMLParser.updatepos

    def state(kind, html):
        p = kind()
        p.feed(html)
        p.close()
        return p.pieces, p.aside, p.title, p.links, p.hidden, p.in_title, p.lasttag, p.cdata_elem, p.rawdata

    bits = """< > </ /> <p> <P> </p> </P\t> <br/> <a|href="x&amp;y"> <a|href='q'> <a|href=z> <A|HREF="k"> <a|href="1"|class="2"> <a||href="w"> <script> </script> </SCRIPT|> <style> </style <title> </title>
        <textarea> </textarea> <!-- --> <!DOCTYPE|html> <!doctype <?xml ?> <! &amp &amp; &lt; & &# &#x41; | x é " ' = <body> </body> <head> </head> <template> </template> <noscript> </noscript> <x:y> <1> <é> <div
        </div </> <p|a="<b>"> <img|src="a>b"> <a|href=""> <a|href> <li|data-x="1">""".split()
    bits = [x.replace("|", " ") for x in bits] + ["\n", "\0"]
    r = random.Random(5)
    for _ in range(3000):
        html = "".join(r.choice(bits) for _ in range(r.randint(1, 30)))
        assert state(warc._Text, html) == state(Plain, html), html


# --- op7


def test_bpe(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [*ODD, "<|endoftext|> it's", *("".join(rng.choice("aé 漢\t\n1!'s​🙂") for _ in range(200)) for _ in range(30))]
    d = docs(spark, texts)
    coded = bpe.encode_documents(d, path, P.PATTERN)
    for r in coded.collect():
        want = ref.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids) == (len(want), want) and r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode_documents(coded, path, P.PATTERN).collect()} == {i: t or "" for i, t in enumerate(texts)}
    codec = bpe.Codec(bpe.parse_ranks(open(path, "rb").read()), P.PATTERN)
    small, bpe.CACHE = bpe.CACHE, 5
    try:
        assert all(codec.encode(t or "") == ref.encode_ordinary(t or "") for t in texts)
    finally:
        bpe.CACHE = small
    assert bpe.encode_documents(d.where("false"), path, P.PATTERN).count() == 0


def test_bpe_of_many_texts_at_once():
    """New pre-tokens of many texts go to the model together, and those in use outlast a full generation."""
    tokens = bpe.parse_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    codec = bpe.Codec(tokens, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    calls, model = [], codec.model

    class Counted:
        def encode(self, pieces, **options):
            calls.append(len(pieces))
            return model.encode(pieces, **options)

    codec.model = Counted()
    texts = [f"xq{'abcdefgh'[i % 8]}zzv common{i} wörd vqqxjq " + "日本" * i for i in range(40)] + ["", " ", "q" * 100]
    want = [np.array(ref.encode_ordinary(t), dtype=np.uint32).tobytes() for t in texts]
    assert list(codec.encode_all(texts)) == want and len(calls) == 1
    small, bpe.CACHE = bpe.CACHE, 30
    try:
        codec.known.young, codec.known.old = {}, {}
        codec.encode(" vqqxjq")
        del calls[:]
        for i in range(200):
            assert codec.encode(f" vqqxjq xxzq{chr(97 + i % 26)}{chr(97 + i // 26)}q") == ref.encode_ordinary(f" vqqxjq xxzq{chr(97 + i % 26)}{chr(97 + i // 26)}q")
        assert sum(calls) == 200 and len(codec.known.young) <= 30 and len(codec.known.old) <= 30
    finally:
        bpe.CACHE = small
    ids = np.random.default_rng(1).integers(0, len(tokens), 500_000)
    assert codec.decode(ids) == b"".join(tokens[i] for i in ids) and codec.decode([]) == b""


def test_bpe_pattern_in_latin_texts():
    assert bpe.PATTERN == P.PATTERN
    split, plain = bpe.splitter(P.PATTERN), regex.compile(P.PATTERN).findall
    every, r = [chr(i) for i in range(256)], random.Random(3)
    few = [*" \n\t'aé1!\xa0\x85\x1c", "'s", "'re", "'ll", "'S", "  ", "²", "漢"]
    for i in range(6000):
        text = "".join(r.choice(every if i % 2 else few) for _ in range(r.randint(0, 30)))
        assert split(text) == plain(text), text
    assert bpe.splitter(r"\S+|\s")("a  b") == ["a", " ", " ", "b"]


# --- op9


def brute_counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality_rules(spark):
    rng = random.Random(8)
    texts = [prose(rng, 120) for _ in range(60)] + ["".join(rng.choice("ZQXJK#|%") + rng.choice(" zq") for _ in range(600)) for _ in range(2)] + [*ODD, "a b\nc\na b\n" * 30, "x y z " * 9 + prose(rng, 60)]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in quality_rules.quality(d).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(t)
    assert not any(got[i].kept for i in (60, 61)) and sum(got[i].kept for i in range(60)) >= 57
    kept = quality_rules.quality_filter(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.quality(d.where("false")).count() == 0




def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over character n-grams, by dictionaries: a function (history, symbol) -> probability."""
    order = quality_rules.ORDER
    level = [Counter() for _ in range(order + 1)]
    for t in texts:
        line = ["^"] * (order - 1) + [" " if c in " \t\n\x0b\x0c\r" else c for c in t]
        level[order].update(tuple(line[i : i + order]) for i in range(len(line) - order + 1))
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    rates, totals = {}, defaultdict(Counter)
    for k in range(1, order + 1):
        n = Counter(level[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        good = all(n[i] for i in (1, 2, 3, 4))
        rates[k] = [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.01), i - 0.01) if good else (0.5, 0.75, 0.9)[i - 1] for i in (1, 2, 3))]
        for g, c in level[k].items():
            totals[k][g[:-1]] += c
            totals[-k][g[:-1]] += rates[k][min(c, 3)]

    def probability(history, symbol):
        p = 1 / 65536
        for k in range(1, order + 1):
            context = tuple(history)[order - k :]
            if totals[k][context]:
                c = level[k][(*context, symbol)]
                p = (c - rates[k][min(c, 3)] if c else 0) / totals[k][context] + totals[-k][context] / totals[k][context] * p
        return p

    return probability, level


def model_of(spark, texts, most):
    d = docs(spark, texts).withColumn("lang", F.lit("xx"))
    counts = quality_rules._grouped(d.select("text", "lang")).select("grp", "text").mapInArrow(quality_rules._count, "grp long, code long, n long").groupBy("grp", "code").agg(F.sum("n").alias("n"))
    table = pa.Table.from_pandas(quality_rules.kneser_ney(counts, most).toPandas(), preserve_index=False)
    return quality_rules._arrays(tuple(quality_rules._packed(table).to_pylist()[0][a] for a in quality_rules._ARRAYS))


def code_of(history, symbol):
    c = 0
    for x in (*history, symbol):
        c = c << 16 | (1 if x == "^" else ord(x) & 0xFFFF)
    return c


def test_kneser_ney(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabcd é漢🙂 ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["aaaa", ""]
    probability, level = brute_kneser_ney(texts)
    arrays = model_of(spark, texts, 1 << 17)
    assert all((a[1:] > a[:-1]).all() for a in (arrays[0], arrays[2]))
    ask = [((*g[:-1],), g[-1]) for g in rng.sample(sorted(level[4]), 200)] + [(tuple(rng.choice("abcd é漢zq") for _ in range(3)), rng.choice("abcd z🙂")) for _ in range(300)]
    got = quality_rules.bits(arrays, np.array([code_of(*x) for x in ask], dtype=np.uint64))
    assert got == pytest.approx([-np.log2(max(probability(*x), 2.0**-40)) for x in ask], abs=1e-3)
    # What is pruned goes to the shorter n-grams: over all symbols the probabilities still sum to one.
    for most in (1 << 17, 20):
        arrays = model_of(spark, texts, most)
        for history in (("^", "^", "^"), ("a", "a", "b"), ("q", "q", "a"), ("q", "q", "q")):
            every = np.array([code_of(history, chr(0)) | x for x in range(1 << 16)], dtype=np.uint64)
            assert (2.0 ** -quality_rules.bits(arrays, every)).sum() == pytest.approx(1, abs=1e-3)


def test_bands_by_brute_force(spark):
    """Verdicts from the scores by plain Python, languages beyond those broadcast included."""
    rng = random.Random(21)
    langs = [None, *(f"l{i}" for i in range(quality_rules.LANGUAGES + 2))]
    texts, of = [], []
    for k, lang in enumerate(langs):
        letters = "".join(chr(97 + (7 * k + j) % 26) for j in range(8)) + "é漢"
        for i in range(9 + k):
            word = lambda: "".join(rng.choice(letters if i else "0123456789") for _ in range(rng.randint(2, 7)))  # noqa: B023, E731
            texts.append(" ".join(word() for _ in range(rng.randint(45, 160))))
            of.append(lang)
    d = docs(spark, texts).withColumn("lang", F.element_at(F.array(*(F.lit(x).cast("string") for x in langs)), F.lit(1)))
    named = spark.createDataFrame(list(enumerate(of)), "doc_id long, lang string")
    d = d.drop("lang").join(named, "doc_id")
    rows = {r.doc_id: r for r in quality_rules.quality(d).collect()}
    assert len(rows) == len(texts)
    for lang in langs:
        mine = [rows[i] for i in range(len(texts)) if of[i] == lang]
        probability, _ = brute_kneser_ney([texts[r.doc_id] for r in mine])
        for r in mine[:3]:
            line = ["^"] * 3 + list(texts[r.doc_id])
            assert r.bits == pytest.approx(np.mean([-np.log2(probability(line[i : i + 3], line[i + 3])) for i in range(len(line) - 3)]), abs=2e-3)
        ok = {r.doc_id: not r.base_failed for r in mine}
        for k, of_row in enumerate((lambda r: round(r.bits * 1000), lambda r: round(r.word_bits * 1000))):
            good = sorted(of_row(r) for r in mine if not r.base_failed)
            middle = good[(len(good) - 1) // 2]
            half = max(quality_rules.BAND * sorted(abs(x - middle) for x in good)[(len(good) - 1) // 2], quality_rules.LEAST[k])
            for r in mine:
                scale = min(quality_rules.WIDE, max(quality_rules.NARROW, (quality_rules.TYPICAL / r.n_words) ** 0.5))
                ok[r.doc_id] &= abs(of_row(r) - middle) <= half * scale
                assert abs(r.word_bits * r.n_words - r.bits * len(texts[r.doc_id])) < 2
        assert {r.doc_id: r.kept for r in mine} == ok


# --- op10


def brute_components(texts, ids):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i in ids if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x in range(len(ids)):
        for y in range(x):
            if sets[x] and sets[y] and None not in (ids[x], ids[y]) and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = find(ids[x]), find(ids[y])
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), find(i) if i is not None else None) for i, s in zip(ids, sets, strict=True)]


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = prose(rng, 150).split()
    texts = [" ".join(base)]
    for _ in range(330):  # more than a block holds, with stragglers that resemble each other and not the centre
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    chain = prose(rng, 60).split()
    for step in range(12):
        texts.append(" ".join(chain[step:] + [f"n{i}" for i in range(step)]))
    texts += [prose(rng, 80) for _ in range(15)] + [texts[0].upper(), *ODD, *ODD]
    order = list(range(len(texts)))
    rng.shuffle(order)
    ids = [None if i == 5 else i for i in order]
    ids[9] = ids[10]
    d = docs(spark, texts, ids=ids)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(d).collect())
    assert got == Counter((*x, x[0] == x[2]) for x in brute_components(texts, ids))
    assert near_duplicates(d.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3), (110, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in parent}
