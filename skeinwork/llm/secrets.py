"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens; DataFrame functions only.

Three fixed kinds (assign, access, hex) are matched leftmost and without overlap, each kind by itself; a match that
fails its length rule is used up and dropped. Beside them every run of token characters of 20 or more with a letter or
digit in it is a candidate. Its encoding is the first of ENCODINGS that has all its characters (digits, hexadecimal, letters of
one case or two, base 32, 36, 62, 64). What ordinary tokens look like is counted in the corpus itself: symbols and pairs of neighbours in
all its words of fewer than 20 letters and digits. Three tests look at a candidate:
- chi-squared over its alphabet: how much more even it is than the corpus's symbols are,
- runs: how far changes of kind (digits, lower-case, upper-case; vowels and consonants where only letters of one case
  occur, low and high digits where only digits do) go from the corpus's rate towards that of random symbols,
- serial correlation: how much less its neighbouring letters and neighbouring digits belong together than in the corpus,
  by the mean log odds of pairs, measured against the spread of that figure over the corpus's own distinct words.
Each gives a p-value of "an ordinary token"; Fisher's method joins the three, and Benjamini-Hochberg at level `q`, within
classes of length over the whole corpus, decides which are reported as kind random. A candidate whose symbols speak
against randomness itself (chi-squared or correlation of neighbouring places in the alphabet, Bonferroni, level `alpha`)
is never reported. Base spans always stay; a candidate that overlaps one is left out. A test in which the corpus's tokens do not
differ from random ones is silent: where numbers in the corpus are random digits, keys of 20 to 23 digits are not told from them (longer
ones are of kind hex).

Null text counts as empty and has no spans. Positions are code points, ends exclusive. Repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored. Texts of any length are scanned whole; words are
counted in pieces of a million characters, so that a word on such a border counts as two.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The fixed patterns, in the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of [0-9a-f]+ that are long enough
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"  # LONG or more
KINDS = ("assign", "access", "hex", "random")
ALPHA = 1e-4
Q = 0.01
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = DIGITS + LOWER + UPPER
#: Encodings in the order in which they are tried: name, alphabet, what a change of kind is.
ENCODINGS = (
    ("digits", DIGITS, "half"), ("hex", DIGITS + "abcdef", "kind"), ("upper hex", DIGITS + "ABCDEF", "kind"),
    ("lower case", LOWER, "vowel"), ("upper case", UPPER, "vowel"), ("base 32", UPPER + "234567", "kind"), ("letters", UPPER + LOWER, "kind"),
    ("base 36", DIGITS + LOWER, "kind"), ("upper base 36", DIGITS + UPPER, "kind"), ("base 62", SYMBOLS, "kind"), ("base 64", SYMBOLS + "+/-_", "kind"),
)
#: How symbols are classed for changes: one class name for each of SYMBOLS.
CLASSES = {
    "half": "l" * 5 + "h" * 5 + "-" * 52,
    "vowel": "-" * 10 + "".join("v" if c in "aeiouy" else "c" for c in LOWER) * 2,
    "kind": "0" * 10 + "a" * 26 + "A" * 26,
}
LONG = 20  # a candidate's least length; words below it are the ordinary tokens
MIXED = 8  # words of fewer characters do not count for changes of kind, being mostly one digit and one letter
#: Prior of the rate of changes of kind in ordinary tokens, worth PRIOR_PAIRS pairs, and the most it may be: keys are among the words too.
CHANGE, MOST_CHANGE, PRIOR_PAIRS = 0.2, 0.25, 100
#: Two symbols of an ordinary token are taken to be equal at most this often (or unevenness to be LEAST_UNEVEN): identifiers are more even than prose.
MOST_EQUAL, LEAST_UNEVEN = 0.05, 0.5
#: Prior of the spread of words' serial figures, worth PRIOR_WORDS words.
SPREAD, PRIOR_WORDS = 1.5, 30
PIECE = 1_000_000
#: Lower ends of the classes of length.
LENGTH_CLASSES = (20, 32, 48, 96)
STEPS = 4  # bins of -ln p for each unit


def _quoted(x: str) -> str:
    return "r'" + x.replace("'", "\\x27") + "'"


def _prefix_sums(arr: str) -> str:
    """Running sums before each element, in pieces of 256, so that long arrays are not copied once for each element."""
    fold = "aggregate({0}, named_struct('s', 0, 'l', cast(array() as array<int>)), (a, x) -> named_struct('s', a.s + x, 'l', concat(a.l, array(a.s))))"
    pieces = f"transform(sequence(0, greatest(size({arr}) - 1, 0) div 256), c -> {fold.format(f'slice({arr}, c * 256 + 1, 256)')})"
    return f"flatten(transform(array({pieces}), p -> flatten(zip_with(p, {fold.format('transform(p, y -> y.s)')}.l, (u, o) -> transform(u.l, v -> v + o)))))"


def _located(pattern: str, quick: str, kind: int, group: int, least: int) -> str:
    """SQL: array<struct<s, k, e, n, x>> of the matches in column t whose group has `least` characters; a cheap look for `quick` comes first."""
    p = _quoted(pattern)
    inner = (
        f"transform(array(named_struct('m', regexp_extract_all(t, {p}, 0), 'g', regexp_extract_all(t, {p}, {group}), 'b', transform(split(t, {p}, -1), y -> length(y)))), z -> "
        f"transform(sequence(1, size(z.m)), i -> named_struct('i', i, 'm', z.m[i - 1], 'g', z.g[i - 1], 'b', z.b[i - 1])))[0]"
    )
    lengths = "transform(w, y -> y.b + length(y.m))"
    return (
        f"case when t rlike {_quoted(quick)} and regexp_count(t, {p}) > 0 then transform(array({inner}), w -> "
        f"filter(zip_with(w, {_prefix_sums(lengths)}, (y, o) -> named_struct('s', o + y.b, 'k', {kind}, 'e', o + y.b + length(y.m), 'n', length(y.g), 'x', y.m)), y -> y.n >= {least}))[0] "
        f"else cast(array() as array<struct<s:int,k:int,e:int,n:int,x:string>>) end"
    )


def _tail(z: str) -> str:
    """Upper tail of the normal distribution (a standard five-term approximation)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    one = f"(exp(-{z} * {z} / 2) / 2.5066282746310002 * {poly})"
    return f"greatest(1e-300D, case when {z} >= 0 then {one} else 1 - {one} end)"


def pair_counts(words: DataFrame) -> dict[tuple[bool, str], int]:
    """How often two symbols are neighbours in words (w, n), by whether the word has MIXED characters and several kinds; at most 2 * 62 * 62 counts."""
    mixed = f"length(w) >= {MIXED} and (w rlike '[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]')"
    pairs = words.where("length(w) > 1").select("n", F.expr(mixed).alias("m"), F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("p"))
    return {(r["m"], r["p"]): r["n"] for r in pairs.groupBy("m", "p").agg(F.sum("n").alias("n")).collect()}


def changes_kind(rule: str, a: str, b: str) -> bool:
    x, y = CLASSES[rule][SYMBOLS.index(a)], CLASSES[rule][SYMBOLS.index(b)]
    return x != y and (x, y) != ("A", "a")  # a capital begins a word


def model_of(counts: dict[tuple[bool, str], int]) -> dict:
    """What ordinary tokens look like, from counts of neighbours: for each encoding the unevenness of its alphabet, the rate
    of changes and the side on which random symbols lie; for each pair of symbols (case folded) its cost less the mean cost, and the variance."""
    both: dict[str, int] = {}
    single = dict.fromkeys(SYMBOLS, 0)
    folded: dict[str, int] = {}
    for (_, p), n in counts.items():
        both[p] = both.get(p, 0) + n
        folded[p.lower()] = folded.get(p.lower(), 0) + n
        single[p[0]] += n
        single[p[1]] += n
    uneven, rate, side = [], [], []
    for _, alphabet, rule in ENCODINGS:
        own = [c for c in alphabet if c in single]
        total = sum(single[c] + 0.5 for c in own)
        seen_uneven = len(alphabet) * sum(((single[c] + 0.5) / total) ** 2 for c in own) - 1
        uneven.append(max(0.0, min(seen_uneven, max(LEAST_UNEVEN, MOST_EQUAL * len(alphabet) - 1))))
        random = sum(changes_kind(rule, a, b) for a in own for b in own) / len(alphabet) ** 2
        seen = [(n, changes_kind(rule, *p)) for (m, p), n in counts.items() if (m or rule != "kind") and p[0] in own and p[1] in own]
        prior = CHANGE if rule == "kind" else random
        r = (sum(n for n, c in seen if c) + prior * PRIOR_PAIRS) / (sum(n for n, _ in seen) + PRIOR_PAIRS)
        rate.append(min(r, MOST_CHANGE) if rule == "kind" else r)
        side.append(1 if random > rate[-1] else -1)
    low = DIGITS + LOWER
    cost, var = [0.0] * 36 ** 2, [0.0] * 36 ** 2
    for group in (DIGITS, LOWER):
        total = sum(folded.get(a + b, 0) + 0.5 for a in group for b in group)
        p = {a + b: (folded.get(a + b, 0) + 0.5) / total for a in group for b in group}
        mean = sum(-x * math.log(x) for x in p.values())
        spread = sum(x * (math.log(x) + mean) ** 2 for x in p.values())
        for ab, x in p.items():
            at = low.index(ab[0]) * 36 + low.index(ab[1])
            cost[at], var[at] = round(-math.log(x) - mean, 3), round(max(spread, 1e-3), 3)
    return {"uneven": uneven, "rate": rate, "side": side, "cost": cost, "var": var, "mean": 0.0, "spread": SPREAD}


def _table(values: list[float]) -> str:
    return f"cast(split('{','.join(f'{v:g}' for v in values)}', ',') as array<double>)"


def _serial(x: str, model: dict) -> str:
    """SQL: normal figure of how little the neighbouring letters and digits of x belong together; 0 without such pairs."""
    at = f"transform(split(lower({x}), ''), h -> instr('{DIGITS + LOWER}', h) - 1)"
    pairs = "zip_with(slice(f, 1, greatest(size(f) - 1, 0)), slice(f, 2, greatest(size(f) - 1, 0)), (i, j) -> if(i < 0 or j < 0, 0, i * 36 + j + 1))"
    sums = lambda t: f"aggregate(filter(g, y -> y > 0), 0.0D, (s, y) -> s + element_at({_table(t)}, y))"
    z = f"coalesce(try_divide({sums(model['cost'])}, sqrt({sums(model['var'])})), 0.0D)"
    return f"transform(transform(array({at}), f -> {pairs}), g -> {z})[0]"


def fit(rows: DataFrame, path: str | None = None) -> dict:
    """The model of ordinary tokens of a whole corpus of texts t: words are counted once and stored, their pairs and the mean and spread
    of the serial figure over distinct words of MIXED letters or more follow from the counts."""
    path = path or common.scratch(rows.sparkSession)
    piece = f"if(length(t) < {PIECE}, t, substring(t, i * {PIECE} + 1, {PIECE}))"
    pieces = rows.select(F.explode(F.expr(f"transform(sequence(0, length(t) div {PIECE}), i -> {piece})")).alias("t"))
    words = pieces.select(F.explode(F.split("t", "[^A-Za-z0-9]+")).alias("w")).where(f"length(w) between 1 and {LONG - 1}").groupBy("w").agg(F.count("*").alias("n"))
    words = common.stored(words, path, "words")
    model = model_of(pair_counts(words))
    z = F.expr(_serial("w", model))
    r = words.where(f"length(w) >= {MIXED} and w rlike '^[A-Za-z]+$'").select(z.alias("z")).agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q")).first()
    n, s, sq = r["n"] + PRIOR_WORDS, r["s"] or 0.0, (r["q"] or 0.0) + PRIOR_WORDS * SPREAD ** 2
    model["mean"] = s / n
    model["spread"] = max(1.0, math.sqrt(max(0.0, sq / n - (s / n) ** 2)))
    return model


def _battery(alpha: float, model: dict) -> str:
    """SQL on y (a candidate span with its string y.x): struct of span, class of length, bin of -ln p, consistent."""
    body = "rtrim('=', y.x)"
    pick = lambda values: "element_at(array(" + ", ".join(values) + "), c.en)"
    number = lambda name: pick([f"{v!r}D" for v in model[name]])
    encoding = "case " + " ".join(f"when {body} rlike '^[{a}]+$' then {i}" for i, (_, a, _) in enumerate(ENCODINGS[:-1], 1)) + f" else {len(ENCODINGS)} end"
    alphabet = "element_at(array(" + ", ".join(f"'{a}'" for _, a, _ in ENCODINGS) + "), b.en)"
    kinds = {rule: f"translate(b.x, '{SYMBOLS}', '{names}')" for rule, names in CLASSES.items()}
    kind = "element_at(array(" + ", ".join(f"'{rule}'" for _, _, rule in ENCODINGS) + "), b.en)"
    kind = "case " + kind + " " + " ".join(f"when '{rule}' then {e}" for rule, e in kinds.items()) + " end"
    size_ = "cast(length(c.a) as double)"
    n = "cast(length(c.x) as double)"
    # counts go by the alphabet, not by the candidate's characters, so that long candidates cost in proportion
    squares = "aggregate(split(c.a, ''), 0.0D, (s, h) -> s + power(cast(length(c.x) - length(replace(c.x, h, '')) as double), 2))"
    chi = f"({size_} / {n} * {squares} - {n})"
    df = f"({size_} - 1)"
    z_chi = f"((power(greatest({chi}, 0) / {df}, 1.0D / 3) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df})))"
    mid = f"(({size_} - 1) / 2)"
    cross = f"aggregate(sequence(1, size(c.v) - 1), 0.0D, (s, i) -> s + (c.v[i - 1] - {mid}) * (c.v[i] - {mid}))"
    z_place = f"({cross} / ({n} * ({size_} * {size_} - 1) / 12) * sqrt({n}))"
    known = "('a', 'A', '0', 'v', 'c', 'l', 'h')"
    changes = f"aggregate(sequence(1, size(c.kd) - 1), 0.0D, (s, i) -> s + if(c.kd[i] = c.kd[i - 1] or c.kd[i] not in {known} or c.kd[i - 1] not in {known} or (c.kd[i - 1] = 'A' and c.kd[i] = 'a'), 0, 1))"
    w = number("rate")
    z_runs = f"(({number('side')} * ({changes} - ({n} - 1) * {w}) - 0.5D) / sqrt(({n} - 1) * {w} * (1 - {w})))"
    z_even = f"(({df} + {n} * {number('uneven')} - {chi}) / sqrt(2 * {df} + 4 * {n} * {number('uneven')}))"
    z_serial = f"(({_serial('c.x', model)} - {model['mean']!r}D) / {model['spread']!r}D)"
    length_class = "case " + " ".join(f"when y.n >= {lo} then {i}" for i, lo in reversed(list(enumerate(LENGTH_CLASSES)))) + " else 0 end"
    c1 = f"named_struct('x', {body}, 'en', {encoding})"
    c2 = f"named_struct('x', b.x, 'en', b.en, 'a', {alphabet}, 'kd', split({kind}, ''), 'v', transform(split(b.x, ''), h -> instr({alphabet}, h) - 1.0D))"
    tests = f"named_struct('zc', {z_chi}, 'zp', {z_place}, 'zr', {z_runs}, 'ze', {z_even}, 'zs', {z_serial})"
    # Fisher's sum of three, whose upper tail has a closed form
    joined = f"(- ln({_tail('q.ze')}) - ln({_tail('q.zr')}) - ln({_tail('q.zs')}))"
    consistent = f"2 * least({_tail('q.zc')}, 2 * {_tail('abs(q.zp)')}) >= {alpha}D"
    return (
        f"transform(transform(transform(transform(array({c1}), b -> {c2}), c -> {tests}), q -> named_struct('j', {joined}, 'ok', {consistent})), q -> "
        f"named_struct('s', y.s, 'e', y.e, 'cl', {length_class}, 'bin', cast(floor((q.j - ln(1 + q.j + q.j * q.j / 2)) * {STEPS}) as int), 'ok', q.ok))[0]"
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, q: float = Q, path: str | None = None) -> DataFrame:
    """(doc_id, base, found): arrays of struct<s, k, e>, base spans and spans that the battery adds, kinds as numbers.

    Texts are read twice, for the words and for the spans; both small results are stored, since the tests need the whole
    corpus's words and the thresholds the p-values of all its candidates."""
    spark = docs.sparkSession
    path = path or common.scratch(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    model = fit(rows.select("t"), path=path)
    raw = rows.select(
        "doc_id",
        F.expr(_located(ASSIGN, r"(?i)(?:passw|secret|token|api_?key)", 0, 2, 6)).alias("a"),
        F.expr(_located(ACCESS, "AKIA", 1, 0, 20)).alias("b"),
        F.expr(_located(HEX, "[0-9a-f]{24}", 2, 0, 24)).alias("c"),
        F.expr(_located(CANDIDATE, r"[A-Za-z0-9+/_=-]{20}", 3, 0, 20)).alias("d"),
    )
    base = "transform(concat(a, b, c), y -> named_struct('s', y.s, 'k', y.k, 'e', y.e))"
    apart = "filter(d, y -> y.x rlike '[0-9A-Za-z]' and length(rtrim('=', y.x)) >= 20 and not exists(concat(a, b, c), o -> o.s < y.e and y.s < o.e))"
    tested = raw.select("doc_id", F.expr(f"array_sort({base})").alias("base"), F.expr(f"transform({apart}, y -> {_battery(alpha, model)})").alias("cands"))
    tested = common.stored(tested, path, "spans")
    # counts by class and bin: at most a few thousand rows, whatever the input
    bins = tested.select(F.explode("cands").alias("c")).groupBy("c.cl", "c.bin").agg(F.count("*").alias("n")).collect()
    limits = []
    for cl in range(len(LENGTH_CLASSES)):
        own = sorted(((r["bin"], r["n"]) for r in bins if r["cl"] == cl), reverse=True)
        m, seen, limit = sum(n for _, n in own), 0, 1 << 30
        for b, n in own:
            seen += n
            if 2.718281828459045 ** (-b / STEPS) <= q * seen / m:
                limit = b
        limits.append(limit)
    lim = "element_at(array(" + ", ".join(map(str, limits)) + "), c.cl + 1)"
    return tested.select("doc_id", "base", F.expr(f"transform(filter(cands, c -> c.ok and c.bin >= {lim}), c -> named_struct('s', c.s, 'k', 3, 'e', c.e))").alias("found"))


def _joined(arr: str) -> str:
    kinds = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), y.k + 1)"
    return f"array_join(transform(array_sort({arr}), y -> concat({kinds}, ':', y.s, ':', y.e)), ',')"


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(common.read_table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"cast(size(filter(base, y -> y.k = {k})) as bigint)")
    return spans.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.expr(f"sha2({_joined('base')}, 256)").alias("base_sha256"), F.expr(_joined("concat(base, found)")).alias("spans"),
    )
