"""Queries that SQL can't state, against plain reimplementations over small tables; tables with clashing columns."""

from __future__ import annotations

import collections
import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import op1_vafile, op2_tokens, op3_licenses, op4_minhash, op5_langid, op6_html, op7_repeats, op8_wordbpe, op9_quality, op10_packing, queries
from foliospark.llm.html_blocks import blocks

from .cases import documents, frame, prose
from .test_text_operators import TOKENIZER, jaccard_classes, library, needs_tokenizers, removed_by_brute_force, sql_rows  # noqa: F401

D = op5_langid.DIMENSIONS


def letter(c):
    return np.random.default_rng([op5_langid.SEED, c]).choice([-1, 1], D)


def bundle(text):
    """Trigrams of letters and single gaps with a letter in the middle, one after another."""
    codes = []
    for ch in "\n" + (text or "") + "\n":
        low = ch.lower()
        code = ord(low if len(low) == 1 else ch) if unicodedata.category(ch)[0] == "L" else 0
        if code or not codes or codes[-1]:
            codes.append(code)
    total = np.zeros(D)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return total


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def languages(train, texts):
    """Language, score and likeness of texts after plain training."""
    vectors = {t: unit(bundle(t)) for t in {*texts, *(t for t, _ in train)}}
    sums = collections.defaultdict(lambda: np.zeros(D))
    for t, lang in train:
        sums[lang] += vectors[t]
    names = sorted(sums)
    units = [unit(sums[k]) for k in names]
    mean = np.mean(units, 0) if len(names) > 1 else np.zeros(D)
    out = {}
    for t in texts:
        if not vectors[t].any():
            out[t] = ("und", 0.0, 0.0)
            continue
        cos = [float(unit(vectors[t] - mean) @ unit(u - mean)) for u in units]
        best = max(range(len(names)), key=lambda i: (round(cos[i], 5), -i))
        out[t] = (names[best], min(1.0, max(0.0, cos[best])), float(vectors[t] @ units[best]))
    return out


def corpus(r, n, words=90):
    made = {"en": "the of and ing tion er th".split(), "de": "der und ung sch ein ver keit".split(), "fr": "le les eau ou ment qui é".split()}
    return [(" ".join(r.choice(made[lang]) + r.choice(made[lang]) for _ in range(words)), lang) for lang in r.choices(sorted(made), k=n)]


def test_language_identification_by_definition(spark):
    r = random.Random(8)
    rows = [(i, t, lang if i % 9 else None, "s", 0, "", 0, 0) for i, (t, lang) in enumerate(corpus(r, 40, 20))] + [(100, "1 2 3", "en", "s", 0, "", 0, 0), (101, "Ünïcödé ẞ 漢字 İ", None, "s", 0, "", 0, 0)]
    got = {x.doc_id: x for x in op5_langid.identify(frame(spark, rows)).collect()}
    train = [(t, lang) for k, t, lang, *_ in rows if lang and not got[k].held_out and k != 100]
    want = languages(train, [x[1] for x in rows])
    for k, t, *_ in rows:
        assert got[k].lang_pred == want[t][0] and abs(got[k].score - want[t][1]) < 1e-4


def test_main_text_by_enumeration(spark):
    field = op6_html.trained()
    pages = [p for p, _ in op6_html.layouts(60, seed=5) if 0 < len(blocks(p)) <= 12][:12]
    found = {x.page_id: x.text for x in op6_html.extract(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    for i, page in enumerate(pages):
        parts = blocks(page)

        def worth(labels):
            total = sum(field.score(b) for b, y in zip(parts, labels) if y)
            steps = zip(parts, parts[1:], labels, labels[1:])
            return total + sum(field.steps(op6_html.container(a) == op6_html.container(b))[x][y] for a, b, x, y in steps)

        best = max(itertools.product((0, 1), repeat=len(parts)), key=worth)
        assert found[i] == " ".join(b.text for b, y in zip(parts, best) if y)


def test_very_long_pages():
    long = "<article>" + "".join(f"<p>Sentence {i} of a very long page, with some words in it.</p>" for i in range(20_000)) + "</article>"
    text = op6_html.main_text(op6_html.trained(), f"<html><body><nav><a href=x>Menu</a></nav>{long}<footer>© site</footer></body></html>")
    assert text.startswith("Sentence 0 ") and text.endswith("in it.") and text.count("Sentence") == 20_000


@needs_tokenizers
def test_pipeline_by_brute_force(spark, tmp_path, library):  # noqa: F811
    import corpus_pipeline

    r = random.Random(31)
    rows = [(i, t, lang if i % 8 else None, "s", len(t)) for i, (t, lang) in enumerate(corpus(r, 24))]
    near = rows[5][1].split()
    near[40] = "changed"
    rows += [(50, rows[3][1], "en", "s", 0), (51, " ".join(near), "en", "s", 0), (52, "### *** " * 60, "en", "s", 0), (53, None, None, None, None), (54, rows[7][1] + " " + corpus(r, 1)[0][0], None, "s", 0), (55, "7 8 9 " * 30 + " 1 2 3 4 5 6 7 8 9 10" * 3, None, "s", 0)]
    rows += [(56, corpus(r, 1)[0][0], "fr", "t", 1), (56, corpus(r, 1)[0][0], "de", "t", 1), rows[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    # quality by its SQL, a row at a time in the table's order
    kept = collections.Counter((x[0], x[1]) for x in sql_rows(f"SELECT doc_id, n_words FROM ({op9_quality.oracle()}) WHERE kept", documents=df.toPandas()))
    words = lambda t: len((t or "").split())
    left = [x for x in rows if kept[x[0], words(x[1])]]
    found = languages([(t, lang) for _, t, lang in {(k, t, lang) for k, t, lang, *_ in left} if lang and any(c.isalpha() for c in t)], [x[1] for x in left])
    left = [x for x in left if found[x[1]][0] != "und" and found[x[1]][2] >= op5_langid.MIN_LIKENESS]
    classes = jaccard_classes([x[:2] for x in left])
    names = {k for k, c in classes if k == c}
    left = list(dict.fromkeys(x[:2] for x in left if x[0] in names))
    removed = removed_by_brute_force(spark, left)
    texts = {}
    for k, t in left:
        n, gone, _, digest = removed[k, t]
        texts.setdefault(k, []).append((n - gone, digest))
    pieces = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[p.doc_id].append(p)
    out = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
    import hashlib

    last = collections.defaultdict(list)
    for x in out.collect():
        last[x.doc_id].append((len(x.text.encode()), hashlib.sha256(x.text.encode()).hexdigest(), x.text, x.lang))
    assert {k: sorted(x[:2] for x in v) for k, v in last.items()} == {k: sorted(x for x in v if x[0]) for k, v in texts.items()}
    assert 52 not in last and 53 not in last and 50 not in last and 51 not in last and len(last[56]) == 2
    assert pieces.keys() == last.keys()
    for k, v in last.items():
        tokens = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for *_, t, _ in v)
        assert sum(p.length for p in pieces[k]) == tokens


NAMES = "row key node h m n p q x doc spans features content bands shingles keep lang_pred held_out margin score chunk g dim ids data kind file number places text_ block rank query_id v embedding_ __doc __spans __keep __features part at value lang2 sentences licenses class_id is_copy".split()


@needs_tokenizers
def test_columns_of_clashing_names(spark, tmp_path):
    rows = [r[:3] for r in documents(n=12) if r[1] is None or len(r[1]) < 4000]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    more = plain.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0 - i % 3]) for i in range(30)], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([(1, "u", "<p>Some words, and more of them.</p>")], "page_id long, url string, html string")
    cases = {
        "top_k": (lambda d: op1_vafile.top_k(d, F.col("vec_id") % 10 == 0), vectors), "tokens": (lambda d: op2_tokens.count_tokens(d, queries.tokenizer("byte_bpe_50k.tiktoken"), queries.PATTERN, queries.END_OF_TEXT).select("doc_id", "n_tokens"), plain),
        "licenses": (op3_licenses.scan, plain), "classes": (op4_minhash.classes, plain), "identify": (op5_langid.identify, plain), "extract": (op6_html.extract, pages), "repeats": (lambda d: op7_repeats.digests(op7_repeats.repeats(d)), plain),
        "encode": (lambda d: op8_wordbpe.encode(d, TOKENIZER), plain), "quality": (op9_quality.quality, plain), "pack": (lambda d: op10_packing.pack(d, TOKENIZER).select("doc_id", "start", "length", "ids"), plain),
    }
    for name, (operator, table) in cases.items():
        extra = table.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in table.columns])
        one, two = operator(table), operator(extra)
        assert one.columns == two.columns, name
        if name != "pack":  # where documents are cut depends on how they are dealt
            assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())), name
        else:
            assert sum(r.length for r in one.collect()) == sum(r.length for r in two.collect())
    for keep in (op4_minhash.one_of_each, op5_langid.accepted, op7_repeats.without_repeats, op9_quality.accepted):
        got = keep(more)
        assert got.columns == more.columns and sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, keep(plain).select("doc_id", "text").collect()))
        assert all(r["row"] == 0 and r["class_id"] == len(NAMES) - 2 for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_probability_jaccard_by_definition(seed):
    r = random.Random(seed)
    for _ in range(50):
        x, y = ({k: r.choice([1, 1, 2, 5]) for k in r.sample(range(30), r.randint(1, 20))} for _ in range(2))
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        block = lambda d: op4_minhash._set(op4_minhash._bytes_of(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])))
        assert abs(op4_minhash.probability_jaccard(block(x), block(y)) - want) < 1e-12


def test_tables_between_stages_are_deleted(spark):
    import os

    from foliospark.llm.common import materialize, scratch, shared_root

    with scratch(spark) as written:
        one, two = materialize(spark.range(5), "one"), materialize(spark.range(7), "two")
        last = written.pop()
    assert two.count() == 7 and one.inputFiles() and os.path.isdir(last) and not any(x.startswith("one-") for x in os.listdir(shared_root(spark)))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from foliospark.llm import common
    from foliospark.operators import relational

    for module, of in ((common, common.shared_root), (relational, relational.shared_folder)):
        cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: None), sparkContext=SimpleNamespace(master="yarn", applicationId="a"))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            of(cluster)
        cluster.conf.get = lambda key, other=None: "/shared/" if key == "spark.checkpoint.dir" else None
        assert of(cluster) == "/shared/a" and module


def test_prose_is_made_alike():
    assert prose(random.Random(1), 5) == prose(random.Random(1), 5)
