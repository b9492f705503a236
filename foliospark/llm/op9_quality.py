"""Quality rules: Jensen-Shannon distance of a document to language references, DataFrame functions only.

Every document gets a histogram over character classes and one over common words. References are the summed histograms
of all documents of each language that the table labels, if they hold MIN_REFERENCE_WORDS words. A document fails when
its nearest reference is farther than a limit; documents below the minimum lengths are judged by the base rules alone.

So are documents that no reference speaks for: those whose language is named but has no reference, and those without a
language whose letters are mostly of one kind (ASCII or not) while no reference's are.

Defined cases: null or empty text has no words and fails the base rules; documents whose language is null are else judged
against the nearest reference; if there is no reference (an empty table, no labels) the base rules alone decide; texts
of any length are read whole; repeated rows are judged each; extra columns of the input, whatever their names, are
ignored by quality() and kept by accepted().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

# Frequent function words, the bins of the word histogram; words of other languages fall in the rest.
COMMON_WORDS = {
    "de": "der die das und in den von zu mit ist im des ein eine für auf sich dem als nicht".split(),
    "en": "the of and to in is that for with on was by are this as at or from an it he be a".split(),
    "es": "el la los las de y en un una que del con por para es se su al lo como".split(),
    "fr": "le la les de des du et un une en que qui dans pour par sur est au pas ce".split(),
}
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "accented", "space", "digit", "stop", "symbol", "other")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_WORDS_FOR_CHARS = 50
MIN_WORDS_FOR_WORDS = 150
MIN_REFERENCE_WORDS = 1000
MAX_CHAR_DISTANCE = 0.29
MAX_WORD_DISTANCE = 0.28


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and binds it in body; a lambda variable is never inlined again."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _dropped(name: str, pattern: str) -> str:
    return f"regexp_replace({name}, '{pattern}', '')"


def feature_column() -> Column:
    """A struct over `text`: the base counts, the character-class histogram and the common-word histogram."""
    repeat = _let(
        "sort_array(transform(arrays_zip(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), slice(w, 3, size(w) - 2)),"
        " (x, i) -> struct(xxhash64(x['0'], x['1'], x['2']) as h, i as i)))",
        "s",
        _let(
            "sort_array(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h or x.h <=> get(s, k + 1).h), x -> x.i))",
            "d",
            "aggregate(transform(d, (x, k) -> least(3, coalesce(get(d, k + 1), x + 3) - x)), 0L, (a, x) -> a + x)",
        ),
    )
    known = ", ".join(f"'{w}'" for w in WORDS)
    counts = "array(" + ", ".join(f"size(c) - size(array_remove(c, '{w}'))" for w in WORDS) + ")"
    words = _let(
        f"array_remove(split(t, '{SPACE}+'), '')",
        "w",
        "struct(cast(size(w) as bigint) as n_words, cast(length(array_join(w, '')) as bigint) as word_chars,"
        f" if(size(w) < 3, 0L, {repeat}) as n_repeat_words,"
        f" {_let(f'filter(transform(w, x -> lower(x)), x -> x in ({known}))', 'c', counts)} as word_hist)",
    )
    lines = _let(
        f"filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')", "l",
        "cast(size(l) - size(array_distinct(l)) as bigint)",
    )
    chain = [
        ("a", "t", r"[a-z]+"), ("b", "a", r"[A-Z]+"), ("e", "b", r"[\\p{L}\\p{M}]+"), ("f", "e", SPACE.replace("\\", "\\\\") + "+"),
        ("g", "f", r"[0-9]+"), ("h", "g", "[-.,;:!?()]+"), ("j", "h", f"[{SYMBOLS}]+"),
    ]
    lengths = ["t", *(x[0] for x in chain)]
    hist = "array(" + ", ".join(f"length({x}) - length({y})" for x, y in zip(lengths, lengths[1:], strict=False)) + ", length(j))"
    chars = f"struct({hist} as char_hist, cast(length(h) - length(j) as bigint) as n_symbols)"
    for name, of, pattern in reversed(chain):
        chars = _let(_dropped(of, pattern), name, chars)
    words = words.replace(SPACE, SPACE.replace("\\", "\\\\"))
    whole = F.expr(f"element_at(transform(array(coalesce(text, '')), t -> struct({words} as w, {lines} as n_dup_lines, {chars} as c)), 1)")
    return whole


Reference = tuple[list[float], list[float]]


def references(found: DataFrame, features: str) -> dict[str, Reference]:
    """Per language that the table labels: its two histograms as shares, summed over all its documents.

    One row for each language comes to the driver.
    """
    char, word = F.col(f"{features}.c.char_hist"), F.col(f"{features}.w.word_hist")
    sums = [F.sum(char[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(word[i]).alias(f"w{i}") for i in range(len(WORDS))]
    sums.append(F.sum(f"{features}.w.n_words").alias("words"))
    out = {}
    for r in found.where(F.col("lang").isNotNull()).groupBy("lang").agg(*sums).where(F.col("words") >= MIN_REFERENCE_WORDS).collect():
        chars, words = [r[f"c{i}"] for i in range(len(CLASSES))], [r[f"w{i}"] for i in range(len(WORDS))]
        words.append(r["words"] - sum(words))
        out[r["lang"]] = ([x / sum(chars) for x in chars], [x / sum(words) for x in words])
    return out


def _nearest(doc: str, refs: list[list[float]]) -> str:
    """SQL: the least Jensen-Shannon distance (base 2) of the share array doc to the references."""
    if not refs:
        return "cast(null as double)"
    part = "(a, b) -> if(a > 0, a * log2(2 * a / (a + b)), 0D) + if(b > 0, b * log2(2 * b / (a + b)), 0D)"
    every = "array(" + ", ".join(f"array({', '.join(f'{x!r}D' for x in r)})" for r in refs) + ")"
    return f"array_min(transform({every}, ref -> sqrt(greatest(0D, aggregate(zip_with({doc}, ref, {part}), 0D, (s, x) -> s + x) / 2))))"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def judged(found: DataFrame, features: str) -> Column:
    """A struct of counts, distances and verdicts over the features, against the references of these documents."""
    refs = references(found, features)
    order = sorted(refs)
    char_js = _let("transform(ch, x -> x / cast(greatest(1, aggregate(ch, 0, (s, y) -> s + y)) as double))", "p", _nearest("p", [refs[k][0] for k in order]))
    word_js = _let(
        "transform(concat(wh, array(cast(n as int) - aggregate(wh, 0, (s, y) -> s + y))), x -> x / cast(greatest(1, n) as double))", "p", _nearest("p", [refs[k][1] for k in order])
    )
    base = f"(n < {MIN_WORDS} or 100 * rep > {MAX_REPEAT_PERCENT} * n)"
    foreign = {c[2] > c[0] + c[1] for c, _ in refs.values()}
    alike = f"if(ch[2] > ch[0] + ch[1], {str(True in foreign).lower()}, {str(False in foreign).lower()})"
    known = f"if(lang is null, {alike}, lang in ({', '.join(map(_quoted, order))}))" if refs else "false"
    near = f"(n < {MIN_WORDS_FOR_CHARS} or not {known} or cj <= {MAX_CHAR_DISTANCE}D)"
    usual = f"(n < {MIN_WORDS_FOR_WORDS} or not {known} or wj <= {MAX_WORD_DISTANCE}D)"
    out = f"struct(n as n_words, f.w.word_chars, f.c.n_symbols, f.n_dup_lines, rep as n_repeat_words, {base} as base_failed, not {base} and {near} and {usual} as kept, cj as char_js, wj as word_js)"
    for value, name in reversed([(features, "f"), ("f.w.n_words", "n"), ("f.w.n_repeat_words", "rep"), ("f.c.char_hist", "ch"), ("f.w.word_hist", "wh"), (char_js, "cj"), (word_js, "wj")]):
        out = _let(value, name, out)
    return F.expr(out)


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, distances to the nearest references, verdicts."""
    found = materialize(docs.select("doc_id", "lang", feature_column().alias("features")), "quality-features")
    return found.select("doc_id", judged(found, "features").alias("j")).select("doc_id", "j.*")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that the rules keep. They are written once with their features, not shuffled."""
    features = fresh(docs, "features")
    found = materialize(docs.withColumn(features, feature_column()), "quality-documents")
    return found.where(judged(found, features)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """SQL for doc_id, the counts, the distances to six digits and the verdicts."""
    quoted = ", ".join(f"'{w}'" for w in WORDS)
    space = r"[\x20\x09-\x0D]"
    last = "t"
    lengths = ["length(t)"]
    for pattern in (r"[a-z]+", r"[A-Z]+", r"[\p{L}\p{M}]+", f"{space}+", "[0-9]+", "[-.,;:!?()]+", f"[{SYMBOLS}]+"):
        last = f"regexp_replace({last}, '{pattern}', '', 'g')"
        lengths.append(f"length({last})")
    hist = "[" + ", ".join(f"{a} - {b}" for a, b in zip(lengths, lengths[1:], strict=False)) + f", {lengths[-1]}]"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * log2(2 * {b} / ({a} + {b})) ELSE 0 END"
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {part('z[1]', 'z[2]')})) / 2))"
    share = lambda c, n: f"list_transform({c}, lambda x: x / CAST(greatest(1, {n}) AS DOUBLE))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
again AS (SELECT r, i FROM g WHERE (r, gram) IN (SELECT (r, gram) FROM g GROUP BY r, gram HAVING count(*) > 1)),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) o(k) GROUP BY r),
f AS (SELECT d.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(covered.n, 0) AS n_repeat_words, {hist} AS ch,
  list_transform([{quoted}], lambda k: len(list_filter(w, lambda x: lower(x) = k))) AS wh FROM d LEFT JOIN covered ON covered.r = d.r),
h AS (SELECT *, list_append(wh, n_words - list_sum(wh)) AS wa FROM f),
ref AS (SELECT lang, {share('c', 'list_sum(c)')} AS c, {share('w', 'list_sum(w)')} AS w FROM (
  SELECT lang, list(s ORDER BY i) FILTER (k = 0) AS c, list(s ORDER BY i) FILTER (k = 1) AS w FROM (
    SELECT lang, 0 AS k, i, sum(ch[i]) AS s FROM h, range(1, {len(CLASSES) + 1}) x(i) WHERE lang IS NOT NULL GROUP BY lang, i
    UNION ALL SELECT lang, 1, i, sum(wa[i]) FROM h, range(1, {len(WORDS) + 2}) x(i) WHERE lang IS NOT NULL GROUP BY lang, i) GROUP BY lang) WHERE list_sum(w) >= {MIN_REFERENCE_WORDS}),
near AS (SELECT r, min({js(share('ch', 'list_sum(ch)'), 'ref.c')}) AS cj, min({js(share('wa', 'n_words'), 'ref.w')}) AS wj FROM h, ref GROUP BY r),
v AS (SELECT *, CASE WHEN lang IS NULL THEN EXISTS (SELECT 1 FROM ref WHERE (ref.c[3] > ref.c[1] + ref.c[2]) = (h.ch[3] > h.ch[1] + h.ch[2])) ELSE lang IN (SELECT lang FROM ref) END AS known, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM h LEFT JOIN near USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {MIN_WORDS_FOR_CHARS} OR NOT known OR cj <= {MAX_CHAR_DISTANCE}) AND (n_words < {MIN_WORDS_FOR_WORDS} OR NOT known OR wj <= {MAX_WORD_DISTANCE}) AS kept,
  round(cj, 6) AS char_js, round(wj, 6) AS word_js FROM v"""
