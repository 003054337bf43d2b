"""Secret scan, in DataFrame functions only: three fixed kinds, and tokens that a battery of tests takes for random.

A token's encoding is inferred from its characters. Chi-squared uniformity over
that alphabet and over its classes of letters, the runs about its middle and the
serial correlation each give a p-value for "these are independent uniform
symbols"; Fisher's method combines them to a score of randomness. How random
structured names look is learned by length, from names put together of the
table's own words and of a fixed few. A token's p-value is the share of names of
its length that look as random, and within each class of length the
Benjamini-Hochberg procedure over all tokens of the table bounds the share of
structured names among the secrets that are reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the three base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN_VALUE = 8
# Of a run whose first part is too short no later part is long enough, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]

#: Tokens of the random kind: runs of encoding characters with a letter and a digit.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
TOKEN_HINT = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, the narrowest first: pattern and alphabet.
ENCODINGS = [
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"^[0-9a-z]+$", DIGITS + LOWER),
    (r"^[0-9A-Z]+$", DIGITS + UPPER),
    (r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    (r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    (r"^[0-9A-Za-z+/_=-]+$", UPPER + LOWER + DIGITS + "+/-_="),
]
BINS, BINS_A_DECADE = 400, 10
#: Classes of characters whose counts are tested too: vowels, common and rare consonants of either case, digits, signs.
CLASSES = ["aeiou", "cdhlmnrst", "bfgjkpqvwxyz", "AEIOU", "CDHLMNRST", "BFGJKPQVWXYZ", DIGITS, "+/-_="]
#: Fixed words of which names are made besides the table's own, and how many such names.
NAME_WORDS = "account address archive backend branch build cache category client cluster config content customer data default deploy document download error event export feature file filter format frontend gateway group handler history image import index input invoice item job key language layer library list local log login mail manager map message metric model module monitor network notification object order output package page parser partner path payment photo pipeline platform plugin price product profile project provider query queue record release report request resource response result sample schedule schema search section server service session setting source stage status storage stream system table target task template test ticket token update upload user value version video view worker".split()
FIXED_NAMES = 40_000
#: Names made of each text's words, and the least number of names that a class of length is judged by.
NAMES_A_TEXT, LEAST_NAMES = 4, 200
MARK, OTHER = "\x01", "\x02"
#: Characters of a token that are held as an array at most.
WIDTH = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where body uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, fold: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each place of an array the fold of all values before it, in about n ** 1.5 steps."""

    def blocks(v: Column, width: Column) -> Column:
        folded = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda k: F.aggregate(F.slice(v, k * width + 1, width), zero, fold))
        before = let(folded, lambda f: F.transform(F.sequence(F.lit(0), F.size(f) - 1), lambda k: F.aggregate(F.slice(f, F.lit(1), k), zero, fold)))
        return let(before, lambda b: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.aggregate(F.slice(v, (i - i % width) + 1, i % width), F.get(b, ((i - i % width) / width).cast("int")), fold)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda w: blocks(v, w))).otherwise(F.array().cast("array<int>")))


def matches(text: Column, patterns: list[tuple[str, Column]]) -> Column:
    """For each (pattern, hint) its leftmost non-overlapping matches as ``array<struct<start, end, text>>`` in code points; no null.

    A text whose hint is not true has none. The patterns share one expression, as
    each costs the driver time to build and plan.
    """

    def pieces(pattern: str, hint: Column) -> Column:
        marked = F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(f"({pattern})" if "(" not in pattern else pattern), F.lit(f"{MARK}$0{MARK}"))
        return F.when(F.coalesce(hint, F.lit(False)), F.split(marked, MARK, -1)).otherwise(F.array().cast("array<string>"))

    def spans(p: Column) -> Column:
        starts = running(F.transform(p, lambda x: F.length(x)), lambda a, b: a + b, F.lit(0))
        every = F.zip_with(starts, p, lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), x.alias("text")))
        return F.filter(every, lambda x, i: i % 2 == 1)

    return F.transform(F.array(*(pieces(p, h) for p, h in patterns)), spans)


def hints(text: Column) -> list[Column]:
    """Whether a text can hold an assign, access or hex span, or a token."""
    return [(text.contains("=") | text.contains(":")) & text.rlike(ASSIGN_HINT), text.contains("AKIA"), text.rlike("[0-9a-f]{32}"), text.rlike(TOKEN_HINT)]


def base_of(found: Column) -> Column:
    """Spans of the kinds assign, access and hex by start, then kind, from the matches of their patterns."""
    assign = F.filter(found[0], lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= ASSIGN_VALUE)
    numbered = F.transform(F.array(assign, found[1], found[2]), lambda every, k: F.transform(every, lambda x: F.struct(x["start"].alias("start"), k.alias("kind"), x["end"].alias("end"))))
    return F.array_sort(F.flatten(numbered))


def base_spans(text: Column) -> Column:
    """Spans of the kinds assign, access and hex by start, then kind."""
    return let(matches(text, list(zip([ASSIGN, ACCESS, HEX], hints(text)))), base_of)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a rational approximation good to about 1e-7."""

    def tail(x: Column) -> Column:
        factor = F.exp(-x * x / 2) * 0.3989422804014327
        return let(1 / (1 + 0.2316419 * x), lambda t: factor * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))

    return let(z, lambda y: let(tail(F.abs(y)), lambda p: F.greatest(F.when(y >= 0, p).otherwise(1 - p), F.lit(1e-45))))


def chi_tail(chi: Column, df: Column) -> Column:
    """P(X > chi) of the chi-squared distribution, by the cube-root approximation."""
    return upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def adjacent(b: Column, letters: Column) -> Column:
    """The sum of products of the codes of characters next to each other, ``WIDTH`` characters at a time."""

    def code(c: Column) -> Column:
        return F.call_function("instr", letters, c) - 1

    def within(part: Column) -> Column:
        codes = F.transform(F.split(part, ""), code)
        products = let(codes, lambda v: F.zip_with(v, F.slice(v, F.lit(2), F.size(v)), lambda x, y: F.coalesce(x * y, F.lit(0))))
        return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)

    def between(parts: Column) -> Column:
        pairs = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda x, y: F.when(y.isNotNull(), code(F.right(x, F.lit(1))) * code(F.left(y, F.lit(1)))).otherwise(0))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + within(x)) + F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)

    return F.when(F.length(b) <= WIDTH, within(b)).otherwise(let(F.split(b, f"(?<=\\G.{{{WIDTH}}})"), between))


def symbol_counts(b: Column, letters: Column) -> Column:
    """``array<struct<n, code>>``: how often each symbol stands in a token, as doubles."""

    def cell(n: Column, symbol: Column) -> Column:
        return F.struct(n.cast("double").alias("n"), (F.call_function("instr", letters, symbol) - 1).cast("double").alias("code"))

    runs = F.split(F.array_join(F.sort_array(F.split(b, "")), ""), r"(?<=(.))(?!\1|$)")
    few = F.transform(runs, lambda r: cell(F.length(r), F.left(r, F.lit(1))))
    # A slot for each symbol of the alphabet, so that a very long token is no array of its characters.
    many = F.transform(F.split(letters, ""), lambda c: cell(F.length(b) - F.length(F.replace(b, c, F.lit(""))), c))
    return F.when(F.length(b) <= WIDTH, few).otherwise(many)


def randomness(token: Column) -> Column:
    """Combined p-value of a token under independent uniform symbols of its inferred alphabet.

    A token of n characters costs about n steps, one of over ``WIDTH`` characters one
    more pass for each symbol of its alphabet; its characters are never all held as an array.
    """
    bare = F.regexp_replace(token, "(?<=[^=])=+$", "")

    def total(cells: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda a, x: a + value(x))

    def battery(b: Column, e: Column, letters: Column, cells: Column) -> Column:
        n, k = F.length(b).cast("double"), F.length(letters).cast("double")
        uniform = chi_tail(F.greatest(total(cells, lambda x: x["n"] * x["n"]) * k / n - n, F.lit(0.0)), k - 1)

        def by_class(shares: Column) -> Column:
            seen = F.array(*(F.length(b) - F.length(F.translate(b, c, "")) for c in CLASSES))
            parts = F.aggregate(F.zip_with(shares, seen, lambda x, y: F.when(x > 0, (y - n * x) * (y - n * x) / (n * x)).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
            return chi_tail(parts, F.size(F.filter(shares, lambda x: x > 0)) - 1)

        def by_runs(high: Column) -> Column:
            # A run ends where the next symbol is on the other side of the middle.
            mean = 2 * high * (n - high) / n + 1

            def ends(sides: Column) -> Column:
                return (2 * F.length(sides) - F.length(F.replace(sides, F.lit("01"), F.lit(""))) - F.length(F.replace(sides, F.lit("10"), F.lit("")))) / 2

            sides = F.call_function("translate", b, letters, F.element_at(F.array(*(F.lit("".join("01"[i >= len(a) / 2] for i in range(len(a)))) for _, a in ENCODINGS)), e))
            return let(mean, lambda m: 2 * upper_tail(F.abs(let(sides, ends) + 1 - m) / F.sqrt(F.greatest((m - 1) * (m - 2) / (n - 1), F.lit(1e-6)))))

        def by_serial(sums: Column) -> Column:
            middle, ends = sums["all"] / n, sums["first"] + sums["last"]
            variance = sums["squares"] - n * middle * middle
            serial = (sums["products"] - middle * (2 * sums["all"] - ends) + (n - 1) * middle * middle) / F.greatest(variance, F.lit(1e-6))
            return 2 * upper_tail(F.abs(serial + 1 / n) * F.sqrt(n))

        parts = F.array(
            uniform,
            let(F.element_at(F.array(*(F.array(*(F.lit(len(set(c) & set(letters)) / len(letters)) for c in CLASSES)) for _, letters in ENCODINGS)), e), by_class),
            let(total(cells, lambda x: F.when(x["code"] >= k / 2, x["n"]).otherwise(0.0)), by_runs),
            let(
                F.struct(
                    total(cells, lambda x: x["n"] * x["code"]).alias("all"),
                    total(cells, lambda x: x["n"] * x["code"] * x["code"]).alias("squares"),
                    adjacent(b, letters).alias("products"),
                    (F.call_function("instr", letters, F.left(b, F.lit(1))) - 1).cast("double").alias("first"),
                    (F.call_function("instr", letters, F.right(b, F.lit(1))) - 1).cast("double").alias("last"),
                ),
                by_serial,
            ),
        )
        half = F.aggregate(parts, F.lit(0.0), lambda a, p: a - F.log(F.least(p, F.lit(1.0))))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6))

    alphabets = F.array(*(F.lit(a) for _, a in ENCODINGS))
    return let(bare, lambda b: let(encoding_of(b), lambda e: let(F.element_at(alphabets, e), lambda a: let(symbol_counts(b, a), lambda c: battery(b, e, a, c)))))


def encoding_of(bare: Column) -> Column:
    """The number, from 1, of the narrowest encoding whose alphabet has all characters."""
    out = F.lit(len(ENCODINGS))
    for i, (pattern, _) in reversed(list(enumerate(ENCODINGS[:-1], 1))):
        out = F.when(bare.rlike(pattern), i).otherwise(out)
    return out


def judged(token: Column) -> tuple[Column, Column]:
    """(level, bin): the class of length, and the place of the p-value's logarithm; the larger, the less random."""
    level = F.least(F.floor(2 * F.log2(F.length(token))), F.lit(24)).cast("int")
    place = F.least(F.greatest(F.floor(-BINS_A_DECADE * F.log10(F.greatest(randomness(token), F.lit(1e-45)))), F.lit(0)), F.lit(BINS)).cast("int")
    return level, place


def name_of(words: Column, style: Column, number: Column) -> Column:
    """A structured name of these words with a number behind them, written in one of six styles."""

    def written(lower: Column) -> Column:
        digits = F.pmod(number, F.lit(1000)).cast("string")
        capital = F.array_join(F.transform(lower, F.initcap), "")
        joined = [F.concat(F.array_join(lower, sign), F.lit(end), digits) for sign, end in (("", ""), ("-", "-"), ("_", "_"), ("/", "-"))]
        forms = [*joined, F.concat(capital, digits), F.concat(F.upper(F.array_join(lower, "_")), F.lit("_"), digits)]
        out = forms[0]
        for k, form in enumerate(forms[1:], 1):
            out = F.when(F.pmod(style, F.lit(len(forms))) == k, form).otherwise(out)
        return out

    return let(F.transform(words, F.lower), written)


def names(text: Column) -> Column:
    """Names made of two to six words next to each other at some places of the text."""

    def made(words: Column, k: Column) -> Column:
        count = F.pmod(F.size(words) + k, F.lit(5)).cast("int") + 2
        start = F.floor(F.size(words) * k / NAMES_A_TEXT).cast("int") + 1
        return name_of(F.slice(words, start, count), F.size(words) + k, 7 * F.size(words) + 11 * k)

    words = F.regexp_extract_all(text, F.lit("[A-Za-z][a-z]{1,15}"), F.lit(0))
    every = let(words, lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.lit(NAMES_A_TEXT - 1)), lambda k: made(w, k))).otherwise(F.array().cast("array<string>")))
    return F.filter(every, lambda x: F.length(x) >= 20)


def tested(found: Column, named: Column) -> Column:
    """``array<struct<start, end, level, bin>>`` of tokens to test, from their matches, and of names, whose start is -1."""
    tokens = F.filter(found, lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]"))
    names = F.transform(named, lambda x: F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), x.alias("text")))

    def told(x: Column) -> Column:
        level, place = judged(x["text"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), level.alias("level"), place.alias("bin"))

    return F.transform(F.concat(tokens, names), told)


def is_token(x: Column) -> Column:
    return x["start"] >= 0


FIXED: list[tuple[int, int, int]] = []


def fixed_names(spark) -> list[tuple[int, int, int]]:
    """(level, bin, number) of names made of ``NAME_WORDS``: the same for all tables, so worked out once in a driver's life."""
    if FIXED:
        return FIXED
    every = F.array(*map(F.lit, NAME_WORDS))
    count = F.pmod(F.col("id"), F.lit(7)).cast("int") + 2
    words = F.transform(F.sequence(F.lit(1), count), lambda j: F.element_at(every, F.pmod(F.xxhash64("id", j), F.lit(len(NAME_WORDS))).cast("int") + 1))
    rows = spark.range(FIXED_NAMES).select(name_of(words, F.col("id"), F.xxhash64("id")).alias("name")).where(F.length("name") >= 20)
    level, place = judged(F.col("name"))
    FIXED.extend(tuple(r) for r in rows.select(level.alias("level"), place.alias("bin")).groupBy("level", "bin").agg(F.count(F.lit(1)).alias("n")).collect())
    return FIXED


def secrets_from(found: DataFrame, more: DataFrame | None = None, rate: float = 0.05) -> dict[int, int]:
    """For each class of length the last bin whose tokens are secrets, at false discovery rate ``rate``.

    Benjamini-Hochberg over all tokens in column ``tested`` of ``found``, against the names
    there and in ``more`` and the fixed ones; there are at most 25 classes of 401
    bins, whatever the table's size. A class with too few names is judged by
    those of the next shorter one that has enough: longer names look less random.
    """

    def binned(table: DataFrame) -> DataFrame:
        return table.select(F.explode("tested").alias("t")).groupBy("t.level", "t.bin", is_token(F.col("t")).alias("token")).agg(F.count(F.lit(1)).alias("n"))

    counts: dict[bool, dict[int, list[int]]] = {True: {}, False: {}}

    def add(token: bool, level: int, place: int, n: int) -> None:
        counts[token].setdefault(level, [0] * (BINS + 1))[place] += n

    for r in (binned(found) if more is None else binned(found).union(binned(more))).collect():
        add(r["token"], r["level"], r["bin"], r["n"])
    for level, place, n in fixed_names(found.sparkSession):
        add(False, level, place, n)
    reference = counts[False]
    enough = sorted(level for level, n in reference.items() if sum(n) >= LEAST_NAMES)
    limits = {}
    for level, n in counts[True].items():
        base = reference[max((x for x in enough if x <= level), default=enough[0])]
        total, seen, alike = sum(n), 0, 0
        for at in range(BINS + 1):
            seen, alike = seen + n[at], alike + base[at]
            if n[at] and (1 + alike) / (1 + sum(base)) <= rate * seen / total:
                limits[level] = at
    return limits


def random_spans(limits: dict[int, int], tested: str = "tested") -> Column:
    """Spans of the tokens in a column that are secrets."""
    least = F.lit(-1)
    cases = None
    for level, at in sorted(limits.items()):
        cases = (lambda t, l=level, a=at, rest=cases: F.when(t["level"] == l, F.lit(a)).otherwise(rest(t) if rest else least))
    kept = F.filter(F.col(tested), lambda t: is_token(t) & (t["bin"] <= (cases(t) if cases else least)))
    return F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))


def hinted(text: Column) -> Column:
    """Whether a text can hold a base span or a token."""
    assign, access, hexes, token = hints(text)
    return assign | access | hexes | token


def found_in(text: Column) -> Column:
    """``struct<base, tested>``: the base spans, and the tokens and names to test, of a text that is not null."""
    patterns = list(zip([ASSIGN, ACCESS, HEX, TOKEN], hints(text)))
    return let(matches(text, patterns), lambda m: F.struct(base_of(m).alias("base"), tested(m[3], names(text)).alias("tested")))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``base`` and ``tested`` of ``docs`` by what one pass over the whole texts finds; a null text is empty."""
    found = docs.withColumn("_found", found_in(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return found.withColumns({"base": F.col("_found.base"), "tested": F.col("_found.tested")}).drop("_found")


def span_list(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", rate: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``base`` and ``spans``: arrays of (start, kind, end), by start, then kind.

    Positions are code points, ends exclusive; ``spans`` are the base ones and
    the random tokens. Null and empty texts have none. Columns named ``base``,
    ``spans``, ``tested`` or ``_found`` are replaced. Repeated rows are scanned each, and
    count each among the tokens of the table. What is found is written to the
    shared folder between the pass that counts and the one that decides.

    Texts and tokens of any length are read whole: a token of n characters costs
    about n steps (4 MB of base64 a few seconds), and m matches of one kind in
    a text m to the power 1.5.
    """
    from ..session import stored

    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans", "tested", "_found")]
    found = stored(find(docs, text).select(*(f"`{c}`" for c in kept), "base", "tested"), "findings")
    limits = secrets_from(found, rate=rate)
    return found.withColumn("spans", F.array_sort(F.concat("base", random_spans(limits)))).drop("tested")


def redacted(text: Column, spans: Column, sign: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by ``sign``; as it was if there is none."""

    def cut(s: Column) -> Column:
        before = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        parts = F.zip_with(s, before, lambda x, b: F.when((x["start"] > b) | ((x["start"] == 0) & (b == 0)), F.concat(F.substring(text, b + 1, x["start"] - b), F.lit(sign))).when(x["start"] == b, F.lit(sign)).otherwise(F.lit("")))
        last = F.aggregate(s, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(spans) > 0, cut(spans)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", rate: float = 0.05, sign: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by ``sign`` and ``n_chars``, if it is a column, counted anew.

    Rows that can hold no secret pass by; what is found in the others is written
    with them between the pass that finds and the one that replaces. Null texts
    stay null; other columns are as they were.
    """
    from ..session import stored

    whole = F.col(f"`{text}`")
    may = F.coalesce(hinted(whole), F.lit(False))
    # Everything of the row in one column, so that no name can clash with those of what is found.
    rows = docs.where(may).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), found_in(whole).alias("found"))
    found = stored(rows.select("row", "found.base", "found.tested"), "findings")
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    others = stored(docs.where(~may).select(tested(none, names(F.coalesce(whole, F.lit("")))).alias("tested")), "names")
    limits = secrets_from(found, others, rate)
    spans = F.array_sort(F.concat("base", random_spans(limits)))
    clean = let(spans, lambda s: redacted(F.col(f"row.`{text}`"), s, sign))
    out = found.select("row", (F.size(spans) > 0).alias("hit"), clean.alias("clean"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if n_chars in columns:
        columns[n_chars] = F.when(F.col("hit"), F.length("clean").cast(docs.schema[n_chars].dataType)).otherwise(columns[n_chars])
    columns[text] = F.col("clean")
    return docs.where(~may).unionByName(out.select(*(x.alias(c) for c, x in columns.items())))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: secrets in every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, keep=["doc_id"])

    def n(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
