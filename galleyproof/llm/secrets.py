"""Secret scans with a battery of randomness tests, in DataFrame functions only.

Three base kinds come from patterns: assignments to secret-like names (``assign``), access
key ids (``access``) and long hexadecimal runs (``hex``). The battery adds ``random``: long
runs of letters and digits mixed, whose encoding is inferred (hex, base32, base64,
base64url, alphanumeric) and whose symbols are tested against uniform randomness by

* chi-squared uniformity over the encoding's alphabet (Wilson-Hilferty tail),
* the number of runs above and below the alphabet's middle,
* the serial correlation of neighbours,

combined by Fisher's method. Tests gain power with length, so p-values are ranked within
classes of length: Benjamini-Hochberg over the corpus sets aside the runs that are
structured, and at most a share ``alpha`` of those set aside in a class are random. Runs
that stay are added, unless they lie within a base span. What is controlled is thus how
many random runs are lost; no share of the added spans is guaranteed to be random, as
structure that the three tests do not see stays. The ranking uses counts per class and bin of -log10 p
(at most 13 x 201), so it is the same at every corpus size and nothing is collected.

Null text is empty. Repeated rows are scanned as they come. Overlaps of kinds are kept.
Extra columns are passed through by ``scan`` and ``redact``. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base patterns, and the kinds in their order.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
#: The runs of [0-9a-f]+ that have 32 characters or more.
WHOLE_HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: A run of the alphabets' characters that the battery looks at.
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets of the encodings, in the order of their symbols.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
}
#: Bins of p-values: 20 for each power of ten, down to 1e-10.
BINS_PER_TEN, LAST_BIN = 20, 200


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


#: Matches that one fold takes; the folds of a text start from sums over the others before them.
FOLD = 256


def _spans(text: str, searched: str, pattern: str, kind: int, keep: str) -> Column:
    """Spans (start, end, kind) of the leftmost non-overlapping matches of ``pattern`` that satisfy ``keep``.

    searched: a condition without which there is no match to keep. keep: a condition on the
    match, s.m, and its second group or, without groups, the match itself, s.g.
    """
    lit = _literal(pattern)
    group = 2 if pattern == ASSIGN else 0
    none = "cast(array() as array<struct<start: bigint, end: bigint, kind: int, m: string, g: string>>)"
    found = (
        f"filter(zip_with(split({text}, {lit}, -1), zip_with(regexp_extract_all({text}, {lit}, 0), regexp_extract_all({text}, {lit}, {group}), (m, g) -> named_struct('m', m, 'g', g)),"
        " (p, x) -> named_struct('gap', length(p), 'm', x.m, 'g', x.g)), x -> x.m is not null)"
    )
    folds = f"transform(sequence(0, greatest(size(all) - 1, 0) div {FOLD}), k -> slice(all, k * {FOLD} + 1, {FOLD}))"
    before = (  # the sums of the folds before each
        "aggregate(folds, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (a, f) -> named_struct("
        "'at', a.at + aggregate(f, 0L, (t, x) -> t + x.gap + length(x.m)), 'out', concat(a.out, array(a.at))), a -> a.out)"
    )
    placed = (
        f"flatten(zip_with(folds, {before}, (f, first) -> aggregate(f, named_struct('at', first, 'out', {none}), (a, x) -> named_struct("
        f"'at', a.at + x.gap + length(x.m), 'out', concat(a.out, array(named_struct('start', a.at + x.gap, 'end', a.at + x.gap + length(x.m), 'kind', {kind}, 'm', x.m, 'g', x.g)))), a -> a.out)))"
    )
    inner = f"element_at(transform(array({folds}), folds -> filter({placed}, s -> {keep})), 1)"
    return F.expr(f"if({searched}, element_at(transform(array({found}), all -> {inner}), 1), {none})")


def _plain(spans: str) -> Column:
    return F.expr(f"transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))")


def base_spans(text: str = "_text") -> dict[str, Column]:
    return {
        "_assign": _spans(text, f"{text} rlike {_literal(ASSIGN)}", ASSIGN, 0, "length(s.g) >= 8"),
        "_access": _spans(text, f"contains({text}, 'AKIA')", ACCESS, 1, "length(s.m) >= 16"),
        "_hex": _spans(text, f"{text} rlike r'{WHOLE_HEX}'", WHOLE_HEX, 2, "true"),
    }


def _upper_tail(z: str) -> str:
    """1 - Phi(z) by the logistic form of Page's approximation, off by 2e-4 at most; rising nowhere."""
    return f"1.0D / (1.0D + exp({z} * (1.5976D + 0.070566D * {z} * {z})))"


def _battery(run: str) -> str:
    """SQL for (length class, bin of p) of a run of characters."""
    body = f"rtrim('=', {run})"
    encoding = (
        f"case when {body} rlike '^([0-9a-f]+|[0-9A-F]+)$' then 'hex' when {body} rlike '^[A-Z2-7]+$' then 'base32' "
        f"when {body} rlike '[+/]' and not {body} rlike '[_-]' then 'base64' when {body} rlike '[_-]' and not {body} rlike '[+/]' then 'base64url' "
        f"when {body} rlike '[+/_-]' then '' else 'alnum' end"
    )
    alphabet = "case e when " + " when ".join(f"'{k}' then '{v}'" for k, v in ALPHABETS.items()) + " else '' end"
    steps = [
        (f"named_struct('b', {body}, 'e', {encoding})", "v0"),
        (f"named_struct('a', {alphabet.replace('case e', 'case v0.e')}, 's', split(if(v0.e = 'hex', lower(v0.b), v0.b), ''))", "v1"),
        ("transform(filter(v1.s, c -> c <> ''), c -> instr(v1.a, c) - 1)", "x"),
        ("named_struct('n', double(size(x)), 'k', double(length(v1.a)), 'mean', aggregate(x, 0D, (t, i) -> t + i) / size(x), 'next', slice(x, 2, size(x)))", "v2"),
        (
            "named_struct("
            "'chi', v2.k / v2.n * aggregate(array_distinct(x), 0D, (t, i) -> t + pow(size(filter(x, j -> j = i)), 2)) - v2.n,"
            "'up', double(size(filter(x, i -> 2 * i >= v2.k))),"
            "'runs', 1D + aggregate(zip_with(slice(x, 1, size(x) - 1), v2.next, (i, j) -> if((2 * i >= v2.k) <> (2 * j >= v2.k), 1D, 0D)), 0D, (t, i) -> t + i),"
            "'var', aggregate(x, 0D, (t, i) -> t + pow(i - v2.mean, 2)),"
            "'cov', aggregate(zip_with(slice(x, 1, size(x) - 1), v2.next, (i, j) -> (i - v2.mean) * (j - v2.mean)), 0D, (t, i) -> t + i))",
            "v3",
        ),
        (
            "named_struct("
            "'zc', (pow(v3.chi / (v2.k - 1), 1D / 3) - 1 + 2D / (9 * (v2.k - 1))) / sqrt(2D / (9 * (v2.k - 1))),"
            "'er', 2 * v3.up * (v2.n - v3.up) / v2.n + 1)",
            "v4",
        ),
        (
            "named_struct("
            "'zc', greatest(-8D, least(8D, v4.zc)),"
            "'zr', if(v4.er <= 2, 8D, least(8D, abs(v3.runs - v4.er) / sqrt((v4.er - 1) * (v4.er - 2) / (v2.n - 1)))),"
            "'zs', if(v3.var = 0, 8D, least(8D, abs(v3.cov / v3.var + 1 / v2.n) * sqrt(v2.n))))",
            "z",
        ),
        (f"-ln({_upper_tail('z.zc')}) - ln(2 * {_upper_tail('z.zr')}) - ln(2 * {_upper_tail('z.zs')})", "h"),
        # Fisher: twice h has six degrees of freedom
        ("(h - ln(1 + h + h * h / 2)) / ln(10D)", "q"),
    ]
    out = f"if(v0.e = '', {LAST_BIN}, int(greatest(0D, least({LAST_BIN}D, floor({BINS_PER_TEN} * q + 1e-9)))))"
    for value, name in reversed(steps):
        out = f"element_at(transform(array({value}), {name} -> {out}), 1)"
    return out


def length_class(n: str) -> str:
    """Eighths of powers of two up to a length of 64, then whole powers, thirteen in all."""
    return f"int(case when {n} < 64 then floor({n} / 8) - 2 else least(12, 6 + floor(log2({n} / 64D) + 1e-9)) end)"


def candidates(text: str = "_text") -> Column:
    """Array of (start, end, class, bin) of the runs in ``text`` that the battery looks at."""
    found = _spans(text, f"{text} rlike r'(?<![A-Za-z0-9+/_-]){RUN}'", f"(?<![A-Za-z0-9+/_-]){RUN}", 3, "(rtrim('=', s.m) rlike '[0-9]' and rtrim('=', s.m) rlike '[A-Za-z]')")
    return F.transform(
        found,
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m")),
    )


def _tested(column: str) -> Column:
    return F.expr(f"transform({column}, s -> named_struct('start', s.start, 'end', s.end, 'class', {length_class('length(s.m)')}, 'bin', {_battery('s.m')}))")


def _with_candidates(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_runs", candidates()).withColumn("_runs", _tested("_runs"))


def structured_from(docs: DataFrame, alpha: float = 0.01) -> dict[int, int]:
    """For each class of length with runs that are set aside, the bin from which they are.

    docs: with a column ``_text`` that has no null. Benjamini-Hochberg with each bin's
    largest p-value, so it sets aside no more than the exact procedure.
    """
    tests = _with_candidates(docs.select("_text")).select(F.explode("_runs").alias("r")).groupBy(F.col("r.class").alias("class"), F.col("r.bin").alias("bin")).agg(F.count("*").alias("n"))
    whole, upward = Window.partitionBy("class"), Window.partitionBy("class").orderBy(F.desc("bin"))
    ranked = tests.select("class", "bin", F.sum("n").over(whole).alias("m"), F.sum("n").over(upward).alias("rank"))
    most = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_TEN)
    rejected = ranked.where(most <= alpha * F.col("rank") / F.col("m")).groupBy("class").agg(F.min("bin").alias("bin"))
    return {r["class"]: r["bin"] for r in rejected.collect()}  # thirteen classes at most


def _scanned(docs: DataFrame, alpha: float) -> DataFrame:
    """(row: all columns of ``docs``, text, base, added)."""
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text")).withColumn("_text", F.coalesce("text", F.lit("")))
    limits = structured_from(named, alpha)
    limit = "coalesce(element_at(map(" + ", ".join(f"{k}, {v}" for k, v in limits.items()) + f"), r.class), {LAST_BIN + 1})" if limits else str(LAST_BIN + 1)
    found = _with_candidates(named.withColumns(base_spans()))
    base = F.array_sort(F.concat(_plain("_assign"), _plain("_access"), _plain("_hex")), _by_start)
    added = F.expr(
        f"""transform(filter(_runs, r -> r.bin < {limit} and not exists(base, b -> b.start <= r.start and r.end <= b.end)),
              r -> named_struct('start', r.start, 'end', r.end, 'kind', 3))"""
    )
    return found.withColumn("base", base).withColumn("added", added).select("row", "text", "base", "added")


def scan(docs: DataFrame, alpha: float = 0.01) -> DataFrame:
    """``docs`` (with text) and its spans: ``base`` and ``added``, arrays of (start, end, kind).

    Columns of these names that ``docs`` has already are replaced.
    """
    kept = [c for c in docs.columns if c not in ("base", "added")]
    return _scanned(docs, alpha).select(*(F.col("row")[c].alias(c) for c in kept), "base", "added")


def _by_start(a: Column, b: Column) -> Column:
    def order(x: Column, y: Column, otherwise: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(otherwise)

    return order(a["start"], b["start"], order(a["kind"], b["kind"], F.lit(0)))


def joined(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def find_secrets(docs: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``docs`` (doc_id, text)."""
    spans = scan(docs.select("doc_id", "text"), alpha).withColumn("all", F.array_sort(F.concat("base", "added"), _by_start))
    counts = [F.expr(f"bigint(size(filter(base, s -> s.kind = {k})))").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return spans.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", alpha: float = 0.01) -> DataFrame:
    """``docs`` with each secret (overlapping spans: their union) replaced by ``mask``; n_chars, if there, is counted anew."""
    spans = _scanned(docs, alpha).withColumn("_all", F.array_sort(F.concat("base", "added"), _by_start))
    masked = F.expr(
        f"""if(size(_all) = 0, text, aggregate(_all, named_struct('at', 0L, 'out', cast(array() as array<string>)),
              (a, s) -> if(s.end <= a.at, a, named_struct('at', s.end, 'out',
                if(s.start < a.at, a.out, concat(a.out, array(substring(text, int(a.at) + 1, int(s.start - a.at)), '{mask}'))))),
              a -> array_join(concat(a.out, array(substring(text, int(a.at) + 1))), '')))"""
    )
    new = {"text": F.col("_masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_all") > 0, F.length("_masked")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return spans.withColumn("_masked", masked).select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
