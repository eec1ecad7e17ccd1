"""Text normalisation and scores of generated answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions.special import common_words, lcs_length, nfkc


def normalized(s: Column, compat: bool = True) -> Column:
    """NFKC, lower case, everything but letters, digits and _ to blanks, blanks collapsed. Null stays null.

    compat=False leaves out NFKC, which only the Python side has; ASCII text is the same either way.
    """
    # Python sees every row, but as null where the text is ASCII: only others are copied there and back.
    plain = s.rlike(r"^\p{ASCII}*$")
    t = F.when(plain, s).otherwise(nfkc(F.when(~plain, s))) if compat else s
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s\x{85}\x{A0}]", " ")
    return F.trim(F.regexp_replace(t, r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+", " "))


def tokens(norm: Column) -> Column:
    """Words of a normalised text; none of an empty or null one."""
    return F.filter(F.split(F.coalesce(norm, F.lit("")), " "), lambda t: t != "")


def containment(gen: Column, ref: Column) -> Column:
    """1.0 if the normalised reference isn't empty and is contained in the normalised answer, else 0.0."""
    return F.when(F.coalesce(F.length(ref), F.lit(0)) == 0, 0.0).otherwise(F.coalesce(F.contains(gen, ref).cast("double"), F.lit(0.0)))


def f1(common: Column, n_gen: Column, n_ref: Column) -> Column:
    """F1 of precision and recall; 1 if both are empty, 0 if one is or nothing is common."""
    p, r = common / n_gen, common / n_ref
    return F.when((n_gen == 0) | (n_ref == 0), ((n_gen == 0) & (n_ref == 0)).cast("double")).when(common == 0, 0.0).otherwise(2 * p * r / (p + r))


def token_f1(g: Column, r: Column) -> Column:
    """F1 of the bags of words: each word counts as often as it is in both."""
    return f1(common_words(F.array_join(g, " "), F.array_join(r, " ")).cast("double"), F.size(g), F.size(r))


def rouge_l(g: Column, r: Column) -> Column:
    """F1 of the longest common subsequence of words."""
    return f1(lcs_length(F.array_join(g, " "), F.array_join(r, " ")).cast("double"), F.size(g), F.size(r))


def content_parts(content: Column) -> Column:
    """A message's text as a list of one typed part; null stays null."""
    return F.when(content.isNotNull(), F.array(F.struct(F.lit("text").alias("type"), content.alias("text"))))
