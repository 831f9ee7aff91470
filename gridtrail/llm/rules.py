"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

Method. Each rule is a measure of the text and a limit, with its work: the characters, words or lines
that it looks at beyond the base measures, which every row gets. On a sample of the smallest hashed ids the rules are
put in order one by one: each time the rule that rejects the most of the texts still standing for the
work on these. Work is counted, not timed, so a table gives one order. Rules run nested, so that a
rule's measure is only computed for texts that the base rules and all earlier rules passed. The order
changes the time and which rule is named, never the verdict.

Defined results. Null, empty and blank texts have no words and fail the base rules. Words are
``[^\\x20\\x09-\\x0D]+``, kept in their case. Texts of any length are measured whole, by the same limits.
Repeated rows are all returned; other columns aren't read, so their names can't clash. An empty table
gives no rows. Where no id is known, the rules run in the order of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, spread

#: Ids of the sample from which costs and selectivities are estimated, and rows of it at most.
SAMPLE_IDS, SAMPLE_ROWS = 400, 1600
#: Separators of words, and the characters counted as symbols: fixed values.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Base limits: fewest words, and most per cent of words in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8


@dataclass(frozen=True)
class Rule:
    """rejects: SQL over text, words (array), n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words; work: SQL for its elementary steps on a text."""

    name: str
    rejects: str
    work: str = "1"


#: Limits lie far outside running prose of any of the languages, so that plain texts pass.
RULES = (
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", "word_chars > 14 * n_words or word_chars < 2 * n_words", "2"),
    Rule("capitals", "100 * (char_length(text) - char_length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 40 * word_chars", "char_length(text)"),
    # distinct words grow faster than the root of the words
    Rule("few_distinct", "n_words >= 50 and 1L * size(array_distinct(words)) * size(array_distinct(words)) < n_words", "2 * n_words + char_length(text)"),
    Rule("exclamations", "100 * (char_length(text) - char_length(translate(text, '!?', ''))) > 30 * n_words", "char_length(text)"),
)

#: Words are hashed once; a window is the hash of its words' hashes.
_WINDOW = f"xxhash64({', '.join(f'get(w, i + {k})' for k in range(WINDOW))})"
_REPEATED = f"""
if(n_words < {WINDOW} + 1, 0L, element_at(transform(array(transform(words, w -> xxhash64(w))), w -> element_at(transform(array(transform(sequence(0, size(w) - {WINDOW}), i -> {_WINDOW})), h ->
  if(size(array_distinct(h)) = size(h), 0L,
    element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x as x, i as i)))), s ->
      element_at(transform(array(sort_array(filter(transform(sequence(0, size(s) - 1), k ->
          if(get(s, k).x <=> get(s, k - 1).x or get(s, k).x <=> get(s, k + 1).x, get(s, k).i, null)), i -> i is not null))), p ->
        aggregate(transform(p, (i, k) -> least({WINDOW}, coalesce(get(p, k + 1) - i, {WINDOW}))), 0L, (a, n) -> a + n)), 1)), 1))), 1)), 1))
"""


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words and the base measures of every row."""
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    out = docs.select(column(docs, id_col).cast("long").alias("doc_id"), text.alias("text"))
    out = out.select("doc_id", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    left = lambda drop: F.char_length("text") - F.char_length(F.translate("text", drop, ""))
    out = out.select(
        "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - left(BLANKS)).cast("long").alias("word_chars"), left(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
    )
    return out.withColumn("n_repeat_words", F.expr(_REPEATED))


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def sample(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of the SAMPLE_IDS smallest hashed ids, SAMPLE_ROWS at most; a first reading of ids only finds them."""
    ids = docs.select(column(docs, id_col).cast("string").alias("id")).where("id is not null")
    h = F.xxhash64("id")
    # of many rows only those of small hashes are held against each other, unless these are too few ids
    most = -(2**63) + (16 * SAMPLE_IDS * 2**64) // max(1, docs.count())
    found = ids.where(h <= min(most, 2**63 - 1)).distinct().orderBy(h, "id").limit(SAMPLE_IDS).collect()
    if len(found) < SAMPLE_IDS and most < 2**63 - 1:
        found = ids.distinct().orderBy(h, "id").limit(SAMPLE_IDS).collect()
    # a list of values, which the files' own statistics can be held against
    kind = docs.schema[id_col].dataType
    return docs.where(column(docs, id_col).isin([F.lit(r["id"]).cast(kind) for r in found])).limit(SAMPLE_ROWS)


def estimated(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Each rule in the order to run, with its mean work and share of rejections among the sampled texts that reach it."""
    texts = measured(sample(docs, id_col), id_col, text_col).where(~base_failed())
    flags = [F.coalesce(F.expr(r.rejects), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    rows = texts.select(*flags, *[F.expr(r.work).cast("double").alias(f"w{i}") for i, r in enumerate(rules)]).collect()  # SAMPLE_ROWS at most
    out, left = [], sorted(range(len(rules)), key=lambda i: rules[i].name)
    while left:
        cost = {i: sum(r[f"w{i}"] for r in rows) / max(1, len(rows)) or 1.0 for i in left}
        share = {i: sum(r[f"r{i}"] for r in rows) / max(1, len(rows)) for i in left}
        best = min(left, key=lambda i: (-share[i] / cost[i], cost[i]))
        out.append({"rule": rules[best], "cost": cost[best], "rejects": share[best]})
        left.remove(best)
        rows = [r for r in rows if not r[f"r{best}"]]
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every row, base_failed, rejected_by (first rule in the order run; null: none) and kept."""
    order = [x["rule"] for x in estimated(docs, rules, id_col, text_col)]
    first = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        first = first.when(F.expr(rule.rejects), F.lit(rule.name))
    out = measured(spread(docs), id_col, text_col).withColumn("base_failed", base_failed())
    return out.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())
