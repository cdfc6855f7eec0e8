"""Gates on what a result may be said to show: verdicts, wording, numbers in prose."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fixed_values as fv
from tessera.functions import text as tx
from tessera.plans.spec import Rules

#: The English words with word ends that know all letters; a look at the first letter comes before
#: all else, as it fails almost everywhere.
_PART = r"[\p{L}\p{N}_]"
ENGLISH = rf"(?i)(?=[cpidle])(?<!{_PART})" + fv.ENGLISH_CAUSAL.removeprefix(r"\b").removesuffix(r"\b") + f"(?!{_PART})"


def once(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rank(strength: Column) -> Column:
    """Place of a strength in the order, from 0."""
    return F.array_position(F.array(*[F.lit(s) for s in fv.STRENGTHS]), strength).cast("int") - 1


def strength_of(order: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in fv.STRENGTHS]), order.cast("int"))


def verdicts(results: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds verdict and max_strength to results (coef, p, pretrend_p, n_checks, n_same_sign,
    permutation_p, consistent, method_family, real_assignment, semantics).

    Failed checks are in n_checks; without checks the share is 0."""
    policy = F.col("method_family") == "policy_causal"
    direction = (F.col("coef") * rules.expected_sign > 0) & (F.col("p") < rules.alpha)
    share = F.when(F.col("n_checks") > 0, F.col("n_same_sign") / F.col("n_checks")).otherwise(0.0)
    doubts = (share < rules.robustness_share) | ~F.coalesce(F.col("permutation_p") < rules.permutation_alpha, F.lit(False)) | (policy & ~F.coalesce(F.col("pretrend_p") >= rules.pretrend_alpha, F.lit(False)))
    usable = F.coalesce(F.col("consistent"), F.lit(False)) & F.col("coef").isNotNull()
    verdict = F.when(~usable, "insufficient").when(~F.coalesce(direction, F.lit(False)), "not_supportive").when(doubts, "mixed").otherwise("supportive")
    causal = policy & F.coalesce(F.col("real_assignment"), F.lit(False)) & F.coalesce(F.col("semantics") == "real_assignment", F.lit(False))
    out = results.withColumn("verdict", verdict)
    return out.withColumn("max_strength", F.when(F.col("verdict").isin("insufficient", "not_supportive"), "insufficient").when(F.col("verdict") == "mixed", "preliminary").when(causal, "causal_cautious").otherwise("associational"))


def same_signs(checks: DataFrame, by: str, rules: Rules = Rules()) -> DataFrame:
    """by, n_checks, n_same_sign from checks (status, coef): failed ones count in n_checks only."""
    same = (F.col("status") == "succeeded") & (F.coalesce("coef", F.lit(0.0)) * rules.expected_sign > 0)
    return checks.groupBy(by).agg(F.count("*").alias("n_checks"), F.count_if(same).alias("n_same_sign"))


def blockers(results: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds blockers, what keeps a result from a stronger verdict, to what ``verdicts`` takes."""
    usable = F.coalesce(F.col("consistent"), F.lit(False)) & F.col("coef").isNotNull()
    share = F.when(F.col("n_checks") > 0, F.col("n_same_sign") / F.col("n_checks")).otherwise(0.0)
    fine = lambda c: F.coalesce(c, F.lit(False))
    tests = [
        (usable, fv.NOT_REPRODUCED),
        (~usable | (share >= rules.robustness_share), fv.FEW_SAME_SIGN),
        (~usable | fine(F.col("permutation_p") < rules.permutation_alpha), fv.PERMUTATION),
        (~usable | (F.col("method_family") != "policy_causal") | fine(F.col("pretrend_p") >= rules.pretrend_alpha), fv.PRETREND),
        (~usable | fine((F.col("coef") * rules.expected_sign > 0) & (F.col("p") < rules.alpha)), fv.DIRECTION),
        (fine(F.col("semantics") == "real_assignment"), fv.NOT_ASSIGNED),
    ]
    return results.withColumn("blockers", F.array_compact(F.array(*[F.when(~good, reason) for good, reason in tests])))


def outcomes(parts: DataFrame, by: str) -> DataFrame:
    """by, outcome, repair: a text is accepted if no paragraph (paragraph, issues) has an issue, else
    the numbers of those to be repaired are listed."""
    bad = F.array_sort(F.collect_list(F.when(F.size("issues") > 0, F.col("paragraph"))))
    return parts.groupBy(by).agg(bad.alias("repair")).select(by, F.when(F.size("repair") == 0, "accepted").otherwise("repair").alias("outcome"), "repair")


def per_claim(judged: DataFrame, claims: DataFrame, run: str) -> DataFrame:
    """run, claim_id, verdict, max_strength for every planned claim (run, claim_id, type): what
    the run did not test, claims other than the main one outside mechanism studies, is
    insufficient."""
    joined = claims.join(judged.select(run, "verdict", "max_strength", "method_family"), run)
    tested = (F.col("type") == "main") | (F.col("method_family") == "mechanism_boundary")
    return joined.select(run, "claim_id", F.when(tested, F.col("verdict")).otherwise("insufficient").alias("verdict"), F.when(tested, F.col("max_strength")).otherwise("insufficient").alias("max_strength"))


def decision_allowed(max_strength: Column, chosen: Column, decision: Column) -> Column:
    """A choice never exceeds the cap; a downgrade lies below it."""
    return (rank(chosen) <= rank(max_strength)) & ((decision != "downgraded") | (rank(chosen) < rank(max_strength)))


def least_strength(claims: DataFrame, by: str) -> DataFrame:
    """The weakest chosen strength of each group."""
    return claims.groupBy(by).agg(strength_of(F.min(rank(F.col("chosen_strength")))).alias("strength"))


def main_claim(claims: DataFrame, by: str) -> DataFrame:
    """One claim (seq, claim_id, type, user_decision) of each group: the first planned as main,
    else called main, else neither deferred nor rejected, else the first."""
    choice = F.when(F.col("type") == "main", 0).when(F.col("claim_id") == "main", 1).when(~F.coalesce(F.col("user_decision"), F.lit("")).isin("deferred", "rejected"), 2).otherwise(3)
    w = Window.partitionBy(by).orderBy(choice, "seq")
    return claims.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def causal_words(text: Column, strength: Column | None = None, titles: Sequence[str] = ()) -> Column:
    """Distinct words that claim a cause, Chinese before English ones, in order of appearance;
    none where the strength allows them. Known titles and clauses that deny, ask or postpone are
    taken out first."""
    cleaned = text
    for title in sorted(set(titles), key=len, reverse=True):
        if title:
            cleaned = F.replace(cleaned, F.lit(title), F.lit(" "))
    # plain searches first: most texts hold nothing to take out, and they are cheap
    stripped = lambda t: F.when(t.rlike("因果|(?i:causality)"), reduce(lambda c, s: F.regexp_replace(c, s, ""), fv.NOT_CLAIMED, t)).otherwise(t)
    english = lambda t: F.when(t.rlike("[《“「\"]"), F.regexp_replace(t, fv.TITLE_SPANS, " ")).otherwise(t)
    words = lambda t: F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(fv.CHINESE_CAUSAL), 0), F.regexp_extract_all(english(t), F.lit(ENGLISH), 0)))
    found = once(once(cleaned, stripped), words)
    return found if strength is None else F.when(strength == "causal_cautious", F.array().cast("array<string>")).otherwise(found)


_CODE = re.compile(r"```[\s\S]*?```|`[^`\n]*`")
_TOKEN = re.compile(r"\{\{num:([a-zA-Z0-9_.]+)\}\}")
_LEXEME = re.compile(r"(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>\d+(?:\.\d+)?)|(?P<sign>\s*[+*/-]\s*)|(?P<bracket>[()])|(?P<space>\s+)|(?P<other>[^\w\s+*/()-]+|.)")
_QUANTITIES = (re.compile(r"\d"), re.compile(fv.CHINESE_QUANTITY), re.compile(fv.ENGLISH_QUANTITY, re.I))


def _partners(lexemes: list[tuple[str, str]]) -> dict[int, int]:
    """Number of the closing bracket for that of each opening one that is closed."""
    opened, out = [], {}
    for i, (_, text) in enumerate(lexemes):
        if text == "(":
            opened.append(i)
        elif text == ")" and opened:
            out[opened.pop()] = i
    return out


def _in_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def states_quantity(text: str) -> bool:
    """Whether prose states a number outside of placeholders, code and formulas.

    The text is read lexeme by lexeme, in one pass. Calls of log and log1p with balanced brackets
    become a blank, chains of terms and signs with a name among them are left out, and so are
    names that hold a digit or an underscore."""
    lexemes = [(m.lastgroup, m[0]) for m in _LEXEME.finditer(_CODE.sub("", _TOKEN.sub("", text)))]
    partner, plain, i, before = _partners(lexemes), [], 0, ""
    while i < len(lexemes):
        kind, own = lexemes[i]
        if own in ("log", "log1p") and not _in_word(before):
            at = i + 1 + (i + 1 < len(lexemes) and lexemes[i + 1][0] == "space")
            if at in partner:
                plain.append(("blank", " "))
                i, before = partner[at] + 1, ")"
                continue
        plain.append((kind, own))
        i, before = i + 1, own[-1]
    out, i, left = [], 0, ""  # left: the last character that stays, or before names that go
    while i < len(plain):
        kind, own = plain[i]
        last = i
        if kind in ("name", "number") and not (i and _in_word(plain[i - 1][1][-1])):
            while last + 2 < len(plain) and plain[last + 1][0] == "sign" and plain[last + 2][0] in ("name", "number"):
                last += 2
        if last > i and any(k == "name" for k, _ in plain[i : last + 1]):
            i = last + 1  # what follows stands where the formula stood
            continue
        if last == i and kind == "name" and not _in_word(left) and (own == "log" or any(c in "0123456789_" for c in own)):
            i, left = i + 1, own[-1]
            continue
        out += [t for _, t in plain[i : last + 1]]
        i, left = last + 1, plain[last][1][-1]
    prose = "".join(out)
    for phrase in fv.NO_QUANTITY:
        prose = prose.replace(phrase, "")
    return any(p.search(prose) for p in _QUANTITIES)


@F.pandas_udf(T.BooleanType())
def _states_quantity(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else states_quantity(t))


_NUMBER_WORDS = fv.ENGLISH_QUANTITY.removeprefix(r"\b(?:").removesuffix(r")\b")
_INITIALS = "".join(sorted({w[0] + w[0].upper() for w in _NUMBER_WORDS.split("|")}))
#: Without any of these a text states no quantity, whatever is left out of it: apart, as each then begins with one
#: plain test of a character, which fails almost everywhere.
_MAYBE = (r"[0-9`]", r"(?=[^\x00-\x7F])[\p{Nd}零〇一二两三四五六七八九十百千万亿半壹贰叁肆伍陆柒捌玖拾佰仟数几倍]", rf"(?=[{_INITIALS}])(?<![A-Za-z0-9_])(?i:{_NUMBER_WORDS})(?![A-Za-z0-9_])")


def has_bare_number(text: Column | str) -> Column:
    """Whether a text states a number outside of placeholders. Most texts are decided by plain
    searches, which are made once; only the others pass through Python."""
    col = F.col(text) if isinstance(text, str) else text
    found = _states_quantity(F.when(reduce(Column.__or__, [col.rlike(p) for p in _MAYBE]), col))
    return F.when(col.isNotNull(), F.coalesce(found, F.lit(False)))


def without_metadata(text: Column, literals: Sequence[str], citations: Sequence[tuple[str, str]] = ()) -> Column:
    """The text without known titles, identifiers and 'author (year)' citations; a literal that
    begins or ends with a letter or digit must stand by itself there."""
    for value in sorted({v for v in literals if v}, key=len, reverse=True):
        word = lambda c: c.isascii() and c.isalnum()
        text = F.regexp_replace(text, (r"(?<![A-Za-z0-9_])" if word(value[0]) else "") + java_quote(value) + (r"(?![A-Za-z0-9_])" if word(value[-1]) else ""), " ")
    for author, year in citations:
        text = F.regexp_replace(text, rf"{java_quote(author)}\s*[（(]\s*{java_quote(year)}\s*[）)]", " ")
    return text


def java_quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def issues(df: DataFrame, text: str, known: Sequence[str], strength: str, section: str | None = None, titles: Sequence[str] = (), literals: Sequence[str] = (), citations: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Adds issues: unknown placeholders, numbers outside placeholders, too strong wording (not
    looked for in sections that describe methods)."""
    col = F.col(text)
    unknown = F.exists(tx.placeholders(col), lambda k: ~k.isin(list(known)) if known else F.lit(True))
    bare = F.regexp_replace(col, r"\{\{num:[a-zA-Z0-9_.]+\}\}", "")
    number = has_bare_number(without_metadata(bare, [*titles, *literals], citations))
    strong = F.size(causal_words(bare, F.lit(strength), titles)) > 0 if section not in fv.METHOD_SECTIONS else F.lit(False)
    found = F.array(F.when(unknown, fv.UNKNOWN_PLACEHOLDER), F.when(number, fv.BARE_NUMBER), F.when(strong, fv.TOO_STRONG))
    return df.withColumn("issues", F.array_compact(found))


def accepted_paragraphs(df: DataFrame, text: str, known: Sequence[str], strength: str, **options) -> DataFrame:
    """One row for each paragraph of each text: its number, text and issues."""
    parts = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, r"\n\n")).alias("paragraph", text))
    return issues(parts, text, known, strength, **options)


def failure_reasons(parts: DataFrame, by: str, text: str = "text", longest: int = 200) -> DataFrame:
    """by, reasons (distinct, joined by ；), snippet of the first failing paragraph."""
    bad = parts.where(F.size("issues") > 0)
    each = bad.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("paragraph", "issues", F.col(text).alias("t")))).alias("all"))
    reasons = F.array_join(F.array_distinct(F.flatten(F.transform("all", lambda x: x["issues"]))), "；")
    first = F.get("all", F.lit(0))["t"]
    return each.select(by, reasons.alias("reasons"), F.when(F.length(first) > longest, F.concat(F.substring(first, 1, longest), F.lit("…"))).otherwise(first).alias("snippet"))


def result_table(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A Markdown table of the results (seq, label, status, coef, se, p, n_obs) of each group, in
    order; the results of a group are those of one analysis."""
    number = tx.format_number_udf
    cells = F.when(F.col("status") == "succeeded", F.concat_ws(" | ", number("coef"), number("se"), number("p"), F.col("n_obs").cast("string"))).otherwise("失败 | — | — | —")
    line = F.concat(F.lit("| "), F.col("label"), F.lit(" | "), cells, F.lit(" |"))
    head = "| 检验 | 系数 | 标准误 | p 值 | 观测数 |\n|---|---:|---:|---:|---:|"
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("all"))
    return listed.select(*by, F.concat(F.lit(head + "\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("markdown"))
