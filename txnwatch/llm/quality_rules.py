"""Quality rules by distribution divergence [DataFrame functions only].

Base counts come from the whole text.  The method's verdict compares two
histograms of a document, its character classes and its common words, with the
reference of its language by Jensen-Shannon distance (base 2, from 0 to 1).  A reference
(``references``) pools the shares of the texts of that language, each text once, so neither
copies nor a few long texts can move it: one short row per language of ``COMMON_WORDS``,
whatever the size of the table.  The query, its SQL and the pipeline share all of this.

Guards: below ``min_words`` words no distance is trusted and the method keeps the
document, as it does where the language named has no reference (another language, or one
with fewer than ``min_reference`` words); a document without a language is held against
the nearest reference.  Small samples stray further from their source, so the limits widen
with ``1 / sqrt(n)``.  A mixture of clean passages strays in one histogram only, so a text is
dropped where both distances pass their limits, the character distance alone a higher one, or
the common words alone are far (``word_limits``): from the language of the text, as only a text
with less than ``least_share`` of it is, or from every mixture of the languages, as only a text
with less than ``least_share`` of the common words is, each beyond what sampling explains.

Null text counts as empty: no words, base_failed.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.common import BLANK_RUN, bind, free_name, table, written

# Frequent function words of each language (public stop-word lists).
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "im", "ist", "ein", "eine"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "es"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur"],
}
WORD_LIST = sorted({w for ws in COMMON_WORDS.values() for w in ws})
SYMBOLS = "#*$%&|<>"
BASE_MIN_WORDS = 10
BASE_MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class DivergenceRules:
    min_words: int = 40
    min_reference: int = 1000
    reference_symbol_percent: int = 5   # texts with a larger share of SYMBOLS stay out of references
    suspect_char: float = 0.17   # a text is dropped where both distances pass these ...
    suspect_word: float = 0.20
    suspect_slack: float = 0.3   # (each limit widens by its slack / sqrt(number of words))
    max_char: float = 0.22       # ... or the character distance alone passes this
    char_slack: float = 0.8
    least_share: float = 0.25    # ... or the common words alone are farther than with this share of them
    word_sigmas: float = 3.0     # (and than the expected sampling distance, so many standard deviations up)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, "[\t-\r]", " "), " "), "")


def repeat_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of ``width`` words that the text has twice or more.

    Window hashes come first: a text whose hashes all differ has no window twice.
    The others compare their windows as text."""
    none = F.lit(0).cast("long")

    def covered(starts):
        steps = F.transform(starts, lambda q, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - q, F.lit(width))))
        return F.aggregate(steps, none, lambda a, x: a + x)

    def starts(s):
        same = F.filter(s, lambda e, k: F.coalesce(e["x"] == F.get(s, k + 1)["x"], F.lit(False))
                        | F.coalesce(e["x"] == F.get(s, k - 1)["x"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    def per_text(w):
        n = F.size(w) - (width - 1)
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)])), F.lit(1), n)

        def exact(h):
            def among(values):
                few = F.filter(F.sequence(F.lit(1), n), lambda i: F.array_contains(values, F.get(h, i - 1)))
                at = F.when(F.size(values) <= 64, few).otherwise(F.sequence(F.lit(1), n))
                windows = F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i, width)).alias("x"), i.alias("i")))
                return bind(F.sort_array(windows), lambda s: bind(starts(s), covered))
            twice = bind(F.sort_array(h), lambda s: F.array_distinct(
                F.filter(s, lambda x, k: F.coalesce(x == F.get(s, k + 1), F.lit(False)))))
            return bind(twice, among)

        return F.when(F.size(w) <= width, none).otherwise(
            bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(exact(h))))

    return bind(words, per_text)


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def char_counts(text: Column) -> Column:
    """Struct of ``blanks``, ``symbols`` and ``classes``, the counts of a-z, A-Z, 0-9, blanks,
    sentence marks, other ASCII, other characters; each pattern is dropped before the next."""
    def length(c):
        return F.char_length(c).cast("long")

    def dropped(left, patterns, counts):
        if patterns:
            return bind(F.regexp_replace(left, patterns[0], ""),
                        lambda rest: dropped(rest, patterns[1:], [*counts, length(left) - length(rest)]))
        symbols = F.regexp_count(left, F.lit("[#*$%&|<>]")).cast("long")
        beyond = length(F.regexp_replace(left, r"[\x00-\x7F]+", ""))
        lower, blanks, upper, digits, marks = counts
        return F.struct(blanks.alias("blanks"), symbols.alias("symbols"),
                        F.array(lower, upper, digits, blanks, marks, length(left) - beyond, beyond).alias("classes"))

    return dropped(text, ["[a-z]+", BLANK_RUN, "[A-Z]+", "[0-9]+", r"[.,;:!?'\"()-]+"], [])


def word_histogram(words: Column) -> Column:
    """Counts of each of ``WORD_LIST``, then of all other words."""
    listed = F.array(*[F.lit(w) for w in WORD_LIST])

    def counts(w):
        common = F.filter(w, lambda x: x.isin(WORD_LIST))
        return bind(common, lambda c: F.concat(
            F.transform(listed, lambda k: (F.size(c) - F.size(F.array_remove(c, k))).cast("long")),
            F.array((F.size(w) - F.size(c)).cast("long"))))

    return bind(words, counts)


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return bind(total.cast("double"), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""
    def term(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def measures(text: Column) -> Column:
    """Struct of a text's base counts and its two histograms (``chars``, ``common``)."""
    def counted(x):
        def with_words(w, m):
            return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(x).cast("long").alias("n_chars"),
                            (F.char_length(x).cast("long") - m["blanks"]).alias("word_chars"), m["symbols"].alias("n_symbols"),
                            dup_lines(x).alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words"),
                            m["classes"].alias("chars"), word_histogram(w).alias("common"))
        return bind(words_of(x), lambda w: bind(char_counts(x), lambda m: with_words(w, m)))

    return bind(F.coalesce(text, F.lit("")), counted)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < BASE_MIN_WORDS) | (100 * s["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * s["n_words"])


def references(measured: DataFrame, rules: DivergenceRules, m: str, lang: str, digest: str) -> dict:
    """{language: (character shares, word shares)}, summed in millionths over its texts that pass the base rules,
    every text once whatever its copies and its length.  Texts whose characters are far from the median text of
    the language stay out, so texts of another kind move nothing while they are fewer than half."""
    rows = measured.select(F.col(lang).alias("lang"), F.col(digest).alias("digest"), F.col(m).alias("m"))
    rows = rows.where(F.col("lang").isin(list(COMMON_WORDS)) & ~base_failed(F.col("m")) & (F.col("m.n_words") >= rules.min_words)
                      & (100 * F.col("m.n_symbols") <= rules.reference_symbol_percent * F.col("m.n_chars")))

    def millionths(counts):
        return F.transform(_shares(counts), lambda x: F.floor(x * 1_000_000))

    texts = written(rows.groupBy("lang", "digest").agg(F.first("m").alias("m")).select(
        "lang", F.col("m.n_words").alias("n"), millionths(F.col("m.chars")).alias("c"), millionths(F.col("m.common")).alias("k")),
        "quality-texts")
    bins = texts.select("lang", F.posexplode("c").alias("i", "x")).groupBy("lang", "i", F.floor(F.col("x") / 1000).alias("bin")).count()
    per: dict = {}
    for r in bins.collect():                                # at most 7 x 1001 rows a listed language
        per.setdefault(r["lang"], [{} for _ in range(7)])[r["i"]][r["bin"]] = r["count"]

    def median(n_in):
        half, seen = (sum(n_in.values()) + 1) // 2, 0
        for b in sorted(n_in):
            seen += n_in[b]
            if seen >= half:
                return b
    centre = {g: [median(x) for x in classes] for g, classes in per.items()}
    if not centre:
        return {}
    far = F.when(F.lit(False), F.lit(0.0))
    for g, mid in centre.items():
        far = far.when(F.col("lang") == g, js_distance(_shares(F.col("c")), F.array(*[F.lit(x / max(1, sum(mid))) for x in mid])))
    near = texts.where(far <= F.lit(rules.max_char) + F.lit(rules.char_slack) / F.sqrt(F.col("n").cast("double")))
    sums = near.groupBy("lang").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("c")[i]) for i in range(7)]).alias("c"),
                                    F.array(*[F.sum(F.col("k")[i]) for i in range(len(WORD_LIST) + 1)]).alias("k"))
    return {r["lang"]: (list(r["c"]), list(r["k"])) for r in sorted(sums.collect()) if r["n"] >= rules.min_reference}


def divergence(p: list, q: list) -> float:
    """Jensen-Shannon divergence (the squared distance) of two lists of shares, base 2."""
    return max(0.0, sum(x * math.log2(2 * x / (x + y)) for u, v in zip(p, q) for x, y in ((u, v), (v, u)) if x > 0) / 2)


def word_limits(refs: dict, rules: DivergenceRules) -> tuple[dict, float]:
    """{language: (own, mixed)} and b: the common words alone drop a text of n words where their distance to
    its language passes sqrt(own + b / n) or that to the nearest mixture of the languages sqrt(mixed + b / n).

    own is the divergence of a text of which ``least_share`` is in its language and the rest in the worst
    other one, mixed that of a text with ``least_share`` of the common words and other words instead.  A sample
    of n words strays from its own source by a divergence of about chi-square / (8 n ln 2), with a degree of
    freedom for each listed word of a language; b is its mean and ``word_sigmas`` standard deviations."""
    shares = {g: [x / max(1, sum(k)) for x in k] for g, (_, k) in refs.items()}
    out = {}
    for g, q in shares.items():
        few = [rules.least_share * x for x in q[:-1]]
        mixed = divergence([*few, 1 - sum(few)], q)
        worst = [divergence([rules.least_share * x + (1 - rules.least_share) * y for x, y in zip(q, r)], q) for r in shares.values()]
        out[g] = (max(mixed, *worst) if len(worst) > 1 else mixed, mixed)
    free = max(len(ws) for ws in COMMON_WORDS.values())
    return out, (free + rules.word_sigmas * math.sqrt(2 * free)) / (8 * math.log(2))


def _times(by: Column):
    return lambda x: x * by


def _words_far(s: Column, shares: Column, w: Column, lang: Column, refs: dict, rules: DivergenceRules) -> Column:
    """The common words alone are far, see ``word_limits``; ``w`` is the distance to the language of the text."""
    if not refs:
        return F.lit(False)
    limits, b = word_limits(refs, rules)
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    listed = F.coalesce(lang.isin(list(refs)), F.lit(False))

    def top(which):
        case = F.when(F.lit(False), F.lit(0.0))
        for g in refs:
            case = case.when(lang == g, F.lit(limits[g][which]))
        return F.sqrt(case.otherwise(F.lit(max(x[which] for x in limits.values()))) + F.lit(b) / n)

    # the mixture: each language by its listed words in the text, and one more for the language of the text
    counts = [sum((s["common"][WORD_LIST.index(x)] for x in COMMON_WORDS[g]), F.lit(0).cast("long"))
              + F.when(~listed | (lang == g), F.lit(1)).otherwise(F.lit(0)) for g in refs]

    def mixture(c):
        total = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
        parts = [F.transform(F.array(*[F.lit(x / max(1, sum(k))) for x in k]), _times(c[i]))
                 for i, (_, k) in enumerate(refs.values())]
        mixed = parts[0]
        for part in parts[1:]:
            mixed = F.zip_with(mixed, part, lambda x, y: x + y)
        return F.transform(mixed, lambda x: x / total)

    near = bind(F.array(*counts), lambda c: js_distance(shares, mixture(c)))
    return (w > top(0)) | (near > top(1))


def verdict(s: Column, lang: Column, refs: dict, rules: DivergenceRules) -> Column:
    """Struct of the base counts, base_failed, kept and both distances (null without a reference), from ``measures``."""
    def distance(shares, which):
        each = {g: F.array(*[F.lit(x / max(1, sum(ck[which]))) for x in ck[which]]) for g, ck in refs.items()}
        if not each:
            return F.lit(None).cast("double")
        case = F.when(F.lit(False), F.lit(0.0))
        for g, q in each.items():
            case = case.when(lang == g, js_distance(shares, q))
        return case.when(lang.isNull(), F.array_min(F.array(*[js_distance(shares, q) for q in each.values()])))

    def limit(top, slack):
        return F.lit(top) + F.lit(slack) / F.sqrt(F.greatest(s["n_words"], F.lit(1)).cast("double"))

    failed = base_failed(s)
    char = F.round(bind(_shares(s["chars"]), lambda p: distance(p, 0)), 9)
    word = F.round(bind(_shares(s["common"]), lambda p: distance(p, 1)), 9)

    def judged(d):
        c, w = F.coalesce(d["c"], F.lit(0.0)), F.coalesce(d["w"], F.lit(0.0))
        near = ((c <= limit(rules.suspect_char, rules.suspect_slack)) | (w <= limit(rules.suspect_word, rules.suspect_slack))) \
            & (c <= limit(rules.max_char, rules.char_slack)) & ~_words_far(s, _shares(s["common"]), w, lang, refs, rules)
        fields = [s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        unknown = lang.isNotNull() & ~lang.isin(list(refs))
        kept = ~failed & ((s["n_words"] < rules.min_words) | unknown | near)
        return F.struct(*fields, failed.alias("base_failed"), kept.alias("kept"), d["c"].alias("char_distance"), d["w"].alias("word_distance"))

    return bind(F.struct(char.alias("c"), word.alias("w")), judged)


def with_quality(df: DataFrame, rules: DivergenceRules | None = None, text: str = "text", lang: str = "lang",
                 out: str = "q", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``df`` (all by default) and one struct column ``out`` (under a
    longer name where a carried column has that one): n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.  Texts are
    measured once and stored with the carried columns; references and verdicts read what is stored."""
    rules, carry = rules or DivergenceRules(), df.columns if carry is None else carry
    m, g, h = free_name(df, "m"), free_name(df, "g"), free_name(df, "h")
    stored = written(df.select(*carry, F.col(lang).alias(g), F.xxhash64(F.col(text)).alias(h), measures(F.col(text)).alias(m)),
                     "quality-measures")
    refs = references(stored, rules, m, g, h)
    return stored.select(*carry, verdict(F.col(m), F.col(g), refs, rules).alias(free_name(df.select(*carry), out)))


def drop_low_quality(df: DataFrame, rules: DivergenceRules | None = None) -> DataFrame:
    """The documents that base rules and divergence keep, their columns unchanged."""
    q = free_name(df, "q")
    return with_quality(df, rules, out=q).where(F.col(q)["kept"]).drop(q)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return with_quality(docs, carry=["doc_id"]).select("doc_id", "q.*")


def _js_sql(p: str, q: str) -> str:
    """SQL of the Jensen-Shannon divergence of two lists of shares."""
    def term(x, y):
        return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    return f"greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda e: {term('e[1]', 'e[2]')} + {term('e[2]', 'e[1]')})) / 2)"


def op1_sql(rules: DivergenceRules | None = None) -> str:
    """DuckDB form of ``op1_quality_rules`` (doc_id must be unique)."""
    r = rules or DivergenceRules()
    blank, n_words = r"[\x20\x09-\x0D]", len(WORD_LIST)
    quoted = ", ".join(f"'{w}'" for w in WORD_LIST)
    langs = ", ".join(f"'{g}'" for g in COMMON_WORDS)
    listed = "CASE g " + " ".join(f"WHEN '{g}' THEN {[WORD_LIST.index(w) + 1 for w in ws]}" for g, ws in COMMON_WORDS.items()) + " END"
    free = max(len(ws) for ws in COMMON_WORDS.values())
    b = (free + r.word_sigmas * math.sqrt(2 * free)) / (8 * math.log(2))

    def gone(c, of="t"):
        return f"(length({of}) - length(regexp_replace({of}, '{c}', '', 'g')))"

    def shares(counts):
        return f"list_transform({counts}, lambda x: coalesce(x::DOUBLE / nullif(list_sum({counts}), 0), 0))"

    def limit(top, slack):
        return f"{top} + {slack} / sqrt(greatest(n_words, 1))"

    marks = r"[.,;:!?''\"()-]".replace('\\"', '"')
    classes = [gone("[a-z]"), gone("[A-Z]"), gone("[0-9]"), gone(blank), gone(marks)]
    beyond = gone(r"[^\x00-\x7F]")
    chars = f"[{', '.join(classes)}, length(t) - {' - '.join(classes)} - {beyond}, {beyond}]"
    few = f"list_transform(q[1:{n_words}], lambda x: {r.least_share} * x)"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{blank}+'), lambda x: x <> '') AS ws FROM d),
c AS (SELECT *, len(ws) AS n_words, {chars} AS chars, list_filter(ws, lambda x: x IN ({quoted})) AS common,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
h AS (SELECT *, list_append(list_transform([{quoted}], lambda k: len(list_filter(common, lambda x: x = k))),
        len(ws) - len(common)) AS words, {gone('[#*$%&|<>]')} AS n_symbols FROM c),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM h)),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win),
cover AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS s FROM seen WHERE n > 1),
rep AS (SELECT doc_id, sum(s) AS n_repeat_words FROM cover GROUP BY doc_id),
m AS (SELECT h.*, coalesce(n_repeat_words, 0)::BIGINT AS n_rep, n_words < {BASE_MIN_WORDS}
        OR 100 * coalesce(n_repeat_words, 0) > {BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed FROM h LEFT JOIN rep USING (doc_id)),
-- references: every text once, in millionths; far from the median text stays out
ok AS (SELECT DISTINCT lang AS g, t, n_words, chars, words FROM m WHERE lang IN ({langs}) AND NOT base_failed
        AND n_words >= {r.min_words} AND 100 * n_symbols <= {r.reference_symbol_percent} * length(t)),
mil AS (SELECT g, n_words, list_transform({shares('chars')}, lambda x: floor(x * 1000000)::BIGINT) AS c,
        list_transform({shares('words')}, lambda x: floor(x * 1000000)::BIGINT) AS k FROM ok),
mid AS (SELECT g, i, list_sort(list(c[i] // 1000))[(count(*) + 1) // 2] AS x FROM mil, (SELECT unnest(range(1, 8)) AS i) GROUP BY g, i),
cen AS (SELECT g, list(x::DOUBLE / greatest(1, s) ORDER BY i) AS q FROM (SELECT *, sum(x) OVER (PARTITION BY g) AS s FROM mid) GROUP BY g),
near AS (SELECT mil.* FROM mil JOIN cen USING (g) WHERE sqrt({_js_sql(shares('c'), 'q')}) <= {limit(r.max_char, r.char_slack)}),
sums AS (SELECT g, list(v ORDER BY i) AS v, kind FROM (
    SELECT g, 'c' AS kind, i, sum(c[i]) AS v FROM near, (SELECT unnest(range(1, 8)) AS i) GROUP BY g, i UNION ALL
    SELECT g, 'w', i, sum(k[i]) FROM near, (SELECT unnest(range(1, {n_words + 2})) AS i) GROUP BY g, i) GROUP BY g, kind),
fit AS (SELECT g, kind, list_transform(v, lambda x: x::DOUBLE / greatest(1, list_sum(v))) AS q FROM sums
        WHERE g IN (SELECT g FROM near GROUP BY g HAVING sum(n_words) >= {r.min_reference})),
-- limits on the common words alone
worst AS (SELECT a.g, max({_js_sql(f"list_transform(list_zip(a.q, o.q), lambda e: {r.least_share} * e[1] + {1 - r.least_share} * e[2])", 'a.q')}) AS x
          FROM fit a, fit o WHERE a.kind = 'w' AND o.kind = 'w' AND a.g <> o.g GROUP BY a.g),
lim AS (SELECT g, greatest(mixed, coalesce(x, 0)) AS own, mixed FROM (
    SELECT g, {_js_sql(f"list_append({few}, 1 - list_sum({few}))", 'q')} AS mixed FROM fit WHERE kind = 'w') LEFT JOIN worst USING (g)),
-- distances to the language of a text, or the nearest where it has none
dist AS (SELECT doc_id, kind, min(sqrt({_js_sql(f"CASE kind WHEN 'c' THEN {shares('chars')} ELSE {shares('words')} END", 'q')})) AS x
         FROM m JOIN fit ON m.lang = fit.g OR m.lang IS NULL GROUP BY doc_id, kind),
part AS (SELECT doc_id, words, n_words, q, list_sum(list_transform({listed}, lambda i: words[i])) + 1 AS n
         FROM (SELECT m.doc_id, m.lang, m.words, m.n_words, fit.g, fit.q FROM m, fit WHERE kind = 'w') WHERE lang IS NULL OR lang = g
         UNION ALL SELECT doc_id, words, n_words, q, list_sum(list_transform({listed}, lambda i: words[i]))
         FROM (SELECT m.doc_id, m.lang, m.words, m.n_words, fit.g, fit.q FROM m, fit WHERE kind = 'w') WHERE lang <> g AND lang IN (SELECT g FROM fit)),
mix AS (SELECT doc_id, any_value(words) AS words, list(struct_pack(q := q, n := n)) AS parts, sum(n) AS total FROM part GROUP BY doc_id),
mixed AS (SELECT doc_id, sqrt({_js_sql(shares('words'), f"list_transform(range(1, {n_words + 2}), lambda k: list_sum(list_transform(parts, lambda e: e.q[k] * e.n / total)))")}) AS x FROM mix),
s AS (SELECT m.doc_id, n_words::BIGINT AS n_words, length(regexp_replace(t, '{blank}+', '', 'g'))::BIGINT AS word_chars,
        n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_rep AS n_repeat_words, base_failed,
        round(dc.x, 9) AS char_distance, round(dw.x, 9) AS word_distance, mixed.x AS mixture,
        m.lang IS NOT NULL AND m.lang NOT IN (SELECT g FROM fit) AS unknown,
        coalesce(lim.own, (SELECT max(own) FROM lim)) AS own, coalesce(lim.mixed, (SELECT max(mixed) FROM lim)) AS least
      FROM m LEFT JOIN dist dc ON dc.doc_id = m.doc_id AND dc.kind = 'c' LEFT JOIN dist dw ON dw.doc_id = m.doc_id AND dw.kind = 'w'
      LEFT JOIN mixed ON mixed.doc_id = m.doc_id LEFT JOIN lim ON lim.g = m.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND (n_words < {r.min_words} OR unknown OR (
        (coalesce(char_distance, 0) <= {limit(r.suspect_char, r.suspect_slack)} OR coalesce(word_distance, 0) <= {limit(r.suspect_word, r.suspect_slack)})
        AND coalesce(char_distance, 0) <= {limit(r.max_char, r.char_slack)}
        AND coalesce(word_distance, 0) <= sqrt(coalesce(own, 2) + {b} / greatest(n_words, 1))
        AND coalesce(mixture, 0) <= sqrt(coalesce(least, 2) + {b} / greatest(n_words, 1)))) AS kept, char_distance, word_distance
FROM s
"""
