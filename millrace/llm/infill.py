"""Fill-in-the-middle: texts cut into prefix, middle and suffix by one counted-quantifier match."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One unit: a word with the white space before it, or white space that no word follows. The
#: quantifiers are possessive: a unit is never given back, so the match runs without recursion.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


@dataclass(frozen=True)
class Infill:
    """`rate` percent of the texts are cut, `spm` percent of those put the suffix first. The marks
    must start with one character that they hold nowhere else."""

    seed: int = 42
    rate: int = 50
    spm: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rule: Infill = Infill(), keep: Sequence[str] | None = None) -> DataFrame:
    """Rows of `docs` (doc_id, text) with n, form, output, prefix_chars and middle_chars.

    A text has n units. The prefix ends after the smaller and the middle after the larger of two
    positions in 0..n drawn from the hash of the seed and the id; the form is drawn from it too.
    A text that is empty, holds a mark or is not drawn stays as it is (`plain`, no lengths); `psm`
    is mark and prefix, mark and suffix, mark and middle; `spm` has the suffix before the prefix. The
    row's own pattern, with as many units as its prefix and middle have, captures all three parts
    in one match, and the replacement puts them in order. Lengths are read back from the output:
    as no part holds a mark, and no mark can begin inside another, the first occurrences are the marks.

    A null text counts as empty, a null id as the empty text in the hash. Repeated rows give equal
    results. An empty input gives an empty result. Columns of `keep` (all by default) that clash
    with the new names raise. Nothing is shuffled; a text of any length is matched in one loop.
    """
    keep = list(docs.columns if keep is None else keep)
    new = {"n", "form", "output", "prefix_chars", "middle_chars"}
    if clash := new & {c.lower() for c in keep}:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    marks = [rule.prefix, rule.suffix, rule.middle]
    if len(set(marks)) < 3 or any(m[:1] != marks[0][:1] or m.count(m[:1]) != 1 or set(m) & set("\\$") for m in marks):
        raise ValueError("marks must be distinct, start with one common character and hold it once")
    whole = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    counted = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        whole.alias("__text"),
        digest.alias("__digest"),
        F.regexp_count(whole, F.lit(UNIT)).cast("long").alias("n"),
    )
    one, other = (_draw(F.col("__digest"), k) % (F.col("n") + 1) for k in (0, 1))
    held = F.lit(False)
    for mark in marks:
        held = held | F.contains("__text", F.lit(mark))
    drawn = counted.select(
        "*",
        F.least(one, other).alias("__a"),
        F.greatest(one, other).alias("__b"),
        F.when((F.col("__text") == "") | held | (_draw(F.col("__digest"), 2) % 100 >= rule.rate), "plain")
        .when(_draw(F.col("__digest"), 3) % 100 < rule.spm, "spm")
        .otherwise("psm")
        .alias("form"),
    )

    def units(count: Column) -> Column:
        return F.concat(F.lit(f"((?:{UNIT}){{"), count.cast("string"), F.lit("}+)"))

    pattern = F.concat(F.lit(r"\A"), units(F.col("__a")), units(F.col("__b") - F.col("__a")), F.lit(r"([\s\S]*+)\z"))
    arranged = F.when(F.col("form") == "spm", f"{rule.suffix}$3{rule.prefix}$1{rule.middle}$2").otherwise(
        f"{rule.prefix}$1{rule.suffix}$3{rule.middle}$2"
    )
    made = drawn.withColumn(
        "output",
        F.when(F.col("form") == "plain", F.col("__text")).otherwise(F.regexp_replace("__text", pattern, arranged)),
    )
    p, s, m = (F.instr("output", F.lit(x)) for x in marks)
    prefix_end = F.when(F.col("form") == "spm", m).otherwise(s)
    return made.select(
        *[F.col(f"`{c}`") for c in keep],
        "n",
        "form",
        "output",
        F.when(F.col("form") != "plain", prefix_end - p - len(rule.prefix)).cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.length("output") + 1 - m - len(rule.middle)).cast("long").alias("middle_chars"),
    )


def restored(rule: Infill = Infill()) -> Column:
    """The original text, from the columns `output` and `form` alone."""

    def between(first: str, second: str) -> Column:
        after = F.instr("output", F.lit(first)) + len(first)
        end = F.instr("output", F.lit(second)) if second else F.length("output") + 1
        return F.substring(F.col("output"), after, end - after)

    spm = F.concat(between(rule.prefix, rule.middle), between(rule.middle, ""), between(rule.suffix, rule.prefix))
    psm = F.concat(between(rule.prefix, rule.suffix), between(rule.middle, ""), between(rule.suffix, rule.middle))
    return F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "spm", spm).otherwise(psm)


_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: The cuts of `documents` with the settings of Infill().
INFILL_SQL = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d,
    regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS u FROM documents
), cut AS (
  SELECT *, len(u)::BIGINT AS n, least(('0x' || d[1:8])::BIGINT % (len(u) + 1), ('0x' || d[9:16])::BIGINT % (len(u) + 1)) AS a,
    greatest(('0x' || d[1:8])::BIGINT % (len(u) + 1), ('0x' || d[9:16])::BIGINT % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || d[17:24])::BIGINT % 100 >= 50
      THEN 'plain' WHEN ('0x' || d[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
    ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
