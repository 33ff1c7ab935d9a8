"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` evaluates every rule once a document and stores the measurements with one bit a failed rule; policies are
versions of a mask over those bits, so changing a policy or asking what one rule costs never reads a text again:
`apply_policy` is a bitwise test and `ablation` a bitwise aggregation over distinct bit patterns.

Defined results: a null text counts as empty (no words: fails `few_words`); a null doc_id is kept as null; repeated rows
are judged one by one; an empty table gives an empty ledger; extra columns are left out before any name is added.
Windows are compared by 64-bit hashes of the words' hashes inside one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, doc_texts

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_WHITE = r"[\x20\x09-\x0D]+"

#: Bit order is part of stored ledgers: append, never reorder.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "2 * n_bangs > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("few_words", "repeated_windows")
BIT = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of what rejects a document: any failed rule among `rules`."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {p.version: p for p in (Policy("v1", BASE), Policy("v2", tuple(r for r in RULES if r != "repeated_lines")))}


def measure(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, doc_id, n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines, n_repeat_words), narrow: no shuffle."""
    trimmed = F.btrim("text", F.lit(SPACE))
    words = doc_texts(docs, *carry).withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE)))
    plain = F.col("text")
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol))
    counted = words.select(
        *carry, "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(plain)).cast("long").alias("n_symbols"),
        ((F.octet_length("text") - F.octet_length(F.replace("text", F.lit("!!")))) / 2).cast("long").alias("n_bangs"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = counted.withColumn(
        "win",
        F.when(F.col("n_words") >= WINDOW, F.transform(F.slice(F.arrays_zip(*[F.slice("h", k + 1, F.size("h")).alias(f"h{k}") for k in range(WINDOW)]), F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda x: F.xxhash64(x))),
    ).drop("h")
    # Most documents repeat no window: only the others are sorted.
    ranked = windows.withColumn(
        "at",
        F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("win")
    same = lambda k, j: F.get("at", k)["h"] == F.get("at", j)["h"]
    starts = ranked.withColumn(
        "starts",
        F.when(
            F.col("at").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False))),
                    lambda k: F.get("at", k)["i"],
                )
            ),
        ),
    ).drop("at")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return starts.select(
        *carry, "doc_id", "n_words", "word_chars", "n_symbols", "n_bangs",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("starts").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The measurements of `measure` and fail_bits long, bit k set where rule k fails."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, carry).withColumn("fail_bits", total)


def rejected(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with kept boolean under the policy."""
    return rows.withColumn("kept", ~rejected(policy))


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """(rule, n_failed, n_only): documents that a rule rejects, and those that nothing else in the policy rejects.

    The ledger shrinks to its distinct bit patterns (at most 2 ** rules) before rules are looked at one by one.
    """
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def op4_quality_rules(docs: DataFrame, policy: Policy = POLICIES["v2"]) -> DataFrame:
    """The ledger's base measurements with the verdicts of the base rules and of the policy."""
    rows = apply_policy(ledger(docs), policy)
    failed = rejected(POLICIES["v1"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_lines", "fail_bits",
        failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"),
    )


def keep_good(docs: DataFrame, policy: Policy = POLICIES["v2"]) -> DataFrame:
    """docs without the documents that the policy rejects, all columns kept; narrow, so nothing is joined or shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = apply_policy(ledger(docs.select("doc_id", "text", row.alias("row")), carry=("row",)), policy)
    # A filter would be pushed below the measurements, with each of them written out wherever the condition names it.
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
m AS (SELECT rid, doc_id, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             ((strlen(text) - strlen(replace(text, '!!', ''))) // 2)::BIGINT AS n_bangs,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win
        FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
gap AS (SELECT rid, least(8, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8)) AS add FROM rep),
cov AS (SELECT rid, sum(add)::BIGINT AS n_repeat_words FROM gap GROUP BY rid),
f AS (SELECT m.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN cov USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
               + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_bangs > n_words THEN 8 ELSE 0 END
               + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
               + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bangs, n_lines, fail_bits,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 31) = 0 AS kept FROM b
"""

#: The ablation of the policy v2 over the same bits: what each rule rejects, and what only it rejects.
ABLATION_ORACLE = ORACLE.rsplit("SELECT doc_id, n_words", 1)[0] + """
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_only FROM b, (VALUES {rules}) r(rule, bit), (SELECT {mask}::BIGINT AS mask) GROUP BY rule
""".format(rules=", ".join(f"('{r}', {BIT[r]}::BIGINT)" for r in POLICIES["v2"].rules), mask=POLICIES["v2"].mask)
