"""PII by fixed patterns, and by bootstrapped contextual extraction from them; DataFrame operations only.

Seeds are the spans of four fixed patterns. Every token with a digit or an @ is an instance; the word before it (or the
key of a key=value token), with the token's coarse shape, is its lexical pattern. Patterns and instances form a graph
that Spark scores in rounds: a pattern's confidence for a kind is the mean score of all its occurrences (shrunk, and
only with several distinct seeds), an instance's score is the noisy-or of its patterns. What no pattern supports counts
against the pattern. Unseen tokens that reach the threshold become spans of the kind, and support further patterns in the
next round. Texts are read once; the graph holds only the instances.

Regular expressions are anchored where a run begins and quantifiers are possessive, so that long runs take linear time.

Defined results: null and empty texts have no spans; instances are tokens of at most `LONGEST` characters (longer ones
only match the fixed patterns); rows that repeat an id are separate rows, each with its own spans; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable

KINDS = ("email", "ip", "card", "phone")
#: Java forms of the fixed patterns. \G or the look-behind is where a leftmost match can begin.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
LONGEST = 128
#: Distinct seeds that a pattern needs, the least confidence of patterns and instances, and the rounds.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.8, 2

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(digits: str) -> str:
    """SQL for: the digit string passes the Luhn check."""
    digit = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    doubled = f"if(i % 2 = 1, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}), {digit})"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + {doubled}) % 10 = 0"


def _zipped(text: str, pattern: str) -> str:
    """SQL for the array of matches as structs (start, value, before): code-point start, match, end of the text before it.

    The texts between matches and the matches, one after the other, give the starts.
    """
    q = _quoted(pattern)
    empty = "cast(array() as array<struct<start:int,value:string,before:string>>)"
    return f"""if(rlike({text}, {q}),
        aggregate(
          zip_with(split({text}, {q}, -1), regexp_extract_all({text}, {q}, 0), (g, v) -> named_struct('gap', g, 'value', v)),
          named_struct('at', 0, 'last', '', 'out', {empty}),
          (a, x) -> if(x.value is null, a, named_struct(
            'at', a.at + length(x.gap) + length(x.value),
            'last', right(x.value, 60),
            'out', array_append(a.out, named_struct('start', a.at + length(x.gap), 'value', x.value, 'before', concat(a.last, right(x.gap, 60)))))),
          a -> a.out),
        {empty})"""


def _base(kind: str) -> str:
    """SQL for the valid spans of one kind as structs (kind, start, end)."""
    gate = {"email": "contains(text, '@')", "phone": "contains(text, '+')", "ip": "contains(text, '.')", "card": "true"}[kind]
    found = f"if({gate}, {_zipped('text', PATTERNS[kind])}, null)"
    digits = "regexp_replace(m.value, '[^0-9]', '')"
    valid = {
        "email": "true",
        "ip": f"rlike(m.value, {_quoted('^' + _OCTET + (r'[.]' + _OCTET) * 3 + '$')})",
        "card": _luhn(digits),
        "phone": f"length({digits}) between 8 and 15",
    }[kind]
    return f"transform(filter(coalesce({found}, array()), m -> {valid}), m -> named_struct('kind', '{kind}', 'start', m.start, 'end', m.start + length(m.value)))"


def _shape(token: Column) -> Column:
    letters, digits = F.length(F.regexp_replace(token, "[^A-Za-z]", "")), F.length(F.regexp_replace(token, "[^0-9]", ""))
    return F.when(F.contains(token, F.lit("@")), F.lit("@")).when(letters == 0, F.lit("9")).when(digits >= letters, F.lit("9a")).otherwise(F.lit("a9"))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, base (spans of the fixed patterns), tokens (start, value, before): one pass over the texts."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = "concat(" + ", ".join(_base(k) for k in KINDS) + ")"
    tokens = f"filter({_zipped('text', TOKEN)}, t -> length(t.value) <= {LONGEST})"
    return durable(source.select("doc_id", F.expr(base).alias("base"), F.expr(tokens).alias("tokens")).withColumn("row", F.monotonically_increasing_id()))


def _occurrences(read: DataFrame) -> DataFrame:
    """row, start, end, value, pattern, kind (of a seed; else null): the pattern-instance graph's edges."""
    one = read.where("size(tokens) > 0").select("row", "base", F.explode("tokens").alias("t")).select("row", "base", "t.*")
    key = F.regexp_extract("value", r"^[\"'(\[{<]*([A-Za-z_]{1,40}[=:])", 0)
    one = one.withColumn("key", F.when(F.length(key) < F.length("value"), key).otherwise(F.lit("")))
    one = one.withColumn("lead", F.length("key") + F.length(F.regexp_extract(F.expr("substring(value, length(key) + 1)"), r"^[^A-Za-z0-9+@]*+", 0)))
    one = one.withColumn("tail", F.length(F.regexp_extract("value", r"(?<![^A-Za-z0-9])[^A-Za-z0-9]*+$|(?<=[A-Za-z0-9])[^A-Za-z0-9]*+$", 0)))
    one = one.where("lead + tail < length(value)")
    one = one.withColumn("core", F.expr("substring(value, lead + 1, length(value) - lead - tail)")).withColumn("from", F.expr("start + lead")).withColumn("to", F.expr("start + length(value) - tail"))
    over = F.expr("filter(base, b -> b.start < to and from < b.end)")
    seed = F.expr("filter(base, b -> b.start = from)")
    left = F.lower(F.regexp_extract("before", r"([^\x20\x09-\x0D]{1,40})[\x20\x09-\x0D]*$", 1))
    pattern = F.concat_ws("|", F.when(F.col("key") != "", F.lower(F.regexp_replace("key", r"^[^A-Za-z_]+", ""))).otherwise(left), _shape(F.col("core")))
    found = one.where((F.size(over) == 0) | (F.size(seed) > 0))
    return found.select("row", F.col("from").alias("start"), F.col("to").alias("end"), F.lower("core").alias("value"), pattern.alias("pattern"), F.expr("try_element_at(filter(base, b -> b.start = from), 1).kind").alias("kind")).where("NOT startswith(pattern, '|')")


def _discovered(edges: DataFrame, support: int, confidence: float, rounds: int) -> DataFrame | None:
    """row, start, end, kind of the unseen tokens that reach the confidence; None if no pattern has enough seeds."""
    scored = edges.withColumn("guess", F.col("kind")).withColumn("score", F.when(F.col("kind").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
    for _ in range(rounds):
        total = scored.groupBy("pattern").agg(F.count("*").alias("n"))
        by_kind = scored.where("guess IS NOT NULL").groupBy("pattern", F.col("guess").alias("as_kind")).agg(F.sum("score").alias("s"), F.count_distinct("value").alias("seeds"))
        strong = by_kind.where(f"seeds >= {support}").join(total, "pattern").withColumn("conf", F.col("s") / (F.col("n") + 0.5)).where(f"conf >= {confidence}")
        strong = durable(strong.select("pattern", "as_kind", "conf"))
        n = strong.count()
        if not n:
            return None
        unseen = edges.where("kind IS NULL").join(broadcast_if_small(strong, n, 128), "pattern")
        lost = F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))
        instances = unseen.groupBy("value", "as_kind").agg((1 - lost).alias("new")).where(f"new >= {confidence}")
        instances = durable(instances.groupBy("value").agg(F.max(F.struct("new", "as_kind")).alias("best")).select("value", "best.new", "best.as_kind"))
        m = instances.count()
        scored = edges.join(broadcast_if_small(instances, m, 192), "value", "left")
        scored = scored.withColumn("guess", F.coalesce("kind", "as_kind")).withColumn("score", F.when(F.col("kind").isNotNull(), F.lit(1.0)).otherwise(F.coalesce("new", F.lit(0.0)))).drop("new", "as_kind")
    # a token is a span where a strong pattern stands before it, not wherever its text occurs
    here = scored.where("kind IS NULL AND guess IS NOT NULL").join(broadcast_if_small(strong, n, 128), "pattern").where("guess = as_kind")
    return here.select("row", "start", "end", F.col("guess").alias("kind"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of `docs`: doc_id, base and spans, arrays of (kind, start, end) in code points, by kind, then start."""
    read = _read(docs, id_col, text_col)
    extra = _discovered(durable(_occurrences(read)), support, confidence, rounds)
    if extra is None:
        return read.select("doc_id", "base", F.col("base").alias("spans"))
    extra = durable(extra.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra")))
    joined = read.join(broadcast_if_small(extra, extra.count(), 512), "row", "left").withColumn("all", F.expr("concat(base, coalesce(extra, array()))"))
    parts = ", ".join(f"array_sort(filter(all, s -> s.kind = '{k}'), (a, b) -> a.start - b.start)" for k in KINDS)
    return joined.select("doc_id", "base", F.expr(f"concat({parts})").alias("spans"))


def joined(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))))")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the rows of `find`."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
