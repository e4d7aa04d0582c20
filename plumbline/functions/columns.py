"""Column helpers. Each takes columns (or names) and returns a Column or a
DataFrame; all of them are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def exact_round(col: str | Column, digits: int) -> Column:
    """Half-up rounding on the decimal value, so that 2.675 gives 2.68 on every
    engine instead of depending on how the double happens to be stored."""
    return F.round(_c(col).cast("decimal(38,10)"), digits).cast("double")


# --- text -----------------------------------------------------------------------
def blank_to_null(col: str | Column, markers: Sequence[str] = fixed.BLANKS) -> Column:
    """Trim, and turn the given missing-value markers into NULL."""
    out = F.trim(_c(col))
    for marker in markers:
        out = F.nullif(out, F.lit(marker))
    return out


def title_case(col: str | Column, delimiters: str = " -") -> Column:
    """Capitalise after any of ``delimiters`` (``initcap`` only breaks at blanks)."""
    cls = "".join("\\" + ch for ch in delimiters)
    words = F.split(F.lower(_c(col)), f"(?<=[{cls}])")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 2**31 - 1))), ""
    )


_CASE = {
    "trim": F.trim,
    "upper": lambda c: F.upper(F.trim(c)),
    "lower": lambda c: F.lower(F.trim(c)),
    "title": lambda c: title_case(F.trim(c)),
}


def standardize_text(df: DataFrame, modes: Mapping[str, str]) -> DataFrame:
    """Trim the named columns and set their case: trim, upper, lower or title."""
    unknown = set(modes.values()) - set(_CASE)
    if unknown:
        raise ValueError(f"unknown modes {sorted(unknown)}; use {sorted(_CASE)}")
    return df.withColumns({name: _CASE[mode](F.col(name)) for name, mode in modes.items()})


def truncate_text(col: str | Column, n: int) -> Column:
    return F.left(_c(col), F.lit(n))


def email_ok(col: str | Column, strict: bool = True) -> Column:
    """True only for a well-formed address; NULL counts as not well formed."""
    pattern = fixed.EMAIL if strict else fixed.EMAIL_LOOSE
    return F.coalesce(F.trim(_c(col)).rlike(pattern), F.lit(False))


def guarded_int(col: str | Column) -> Column:
    """Digits become a number, everything else (missing included) becomes 0."""
    text = F.trim(_c(col))
    return F.coalesce(F.when(text.rlike(fixed.DIGITS), text.try_cast("long")), F.lit(0).cast("long"))


def is_count(col: str | Column) -> Column:
    """Digits only, and few enough to be a number."""
    text = F.trim(_c(col))
    return text.rlike(fixed.DIGITS) & text.try_cast("long").isNotNull()


# --- record strings ----------------------------------------------------------------
def rebuild_record(cols: Iterable[str | Column]) -> Column:
    """One delimited line holding every field: NULL stays an empty field, and a
    field with a comma or quote is quoted, so the line can be read back."""
    def field(col: str | Column) -> Column:
        text = F.coalesce(_c(col), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.contains(",") | text.contains('"'), quoted).otherwise(text)

    return F.concat_ws(",", *[field(c) for c in cols])


def bad_record_len(col: str | Column, n: int, quoted: bool = True) -> Column:
    """Does the record have other than ``n`` fields? Commas inside quotes do not
    separate fields unless ``quoted`` is off."""
    text = _c(col)
    bare = outside_quotes(text) if quoted else text
    return (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1) != n


def outside_quotes(col: str | Column) -> Column:
    """The text without its quoted parts; a quote that is never closed opens the rest. A doubled quote is the
    end of one part and the start of the next, so no alternative is needed and a field of any length is
    matched without recursion."""
    return F.regexp_replace(_c(col), r'"[^"]*+("|$)', "")


def first_token(col: str | Column, sep: str = ",") -> Column:
    return F.substring_index(_c(col), sep, 1)


def record_has_token(col: str | Column, token: str) -> Column:
    """Is ``token`` one whole field of the record?"""
    return _c(col).rlike(f"(^|,){token}(,|$)")


# --- dates ----------------------------------------------------------------------------
def parse_any(col: str | Column, formats: Sequence[str] = (fixed.SEND_FORMAT,)) -> Column:
    """First format that reads the text wins; unreadable text gives NULL."""
    text = _c(col)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def month_label(col: str | Column) -> Column:
    return F.date_format(_c(col), "yyyy-MM")


def date_key(col: str | Column) -> Column:
    return F.date_format(_c(col), "yyyyMMdd")


# --- numbers --------------------------------------------------------------------------
def safe_ratio(num: str | Column, den: str | Column, scale: float = 1) -> Column:
    """``scale * num / den``, NULL when the divisor is 0 or NULL."""
    ratio = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    return ratio if scale == 1 else ratio * F.lit(float(scale))


def zero_fill(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def weighted_score(weights: Mapping[str, float] = fixed.SCORE_WEIGHTS) -> Column:
    """Weighted sum of the named counters; a missing counter counts 0."""
    terms = [F.coalesce(F.col(c), F.lit(0)).cast("double") * F.lit(w) for c, w in weights.items()]
    return reduce(lambda a, b: a + b, terms)


# --- categories -----------------------------------------------------------------------
def band(col: str | Column, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first (highest) threshold reached; NULL falls to the default."""
    value = _c(col)
    out = F.lit(default)
    for low, label in sorted(steps):
        out = F.when(value >= F.lit(low), F.lit(label)).otherwise(out)
    return out


_FOLD = {None: lambda c: c, "upper": F.upper, "lower": F.lower}


def _folded(col: str | Column, fold: str | None, accents: bool) -> Column:
    c = _c(col)
    if accents:
        c = F.regexp_replace(F.translate(c, "áéíóúàèìòùâêîôûäëïöüñçÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÑÇ",
                                         "aeiouaeiouaeiouaeiouncAEIOUAEIOUAEIOUAEIOUNC"), "[’`]", "'")
    return _FOLD[fold](c)


def flag_in(col: str | Column, values: Iterable[str], fold: str | None = "lower",
            fold_accents: bool = False) -> Column:
    """Membership as a two-valued flag: NULL is not a member."""
    return F.coalesce(_folded(col, fold, fold_accents).isin(*values), F.lit(False))


def map_values(col: str | Column, groups: Mapping, default, fold: str | None = "upper",
               fold_accents: bool = False) -> Column:
    """Label of the list that holds the value, else ``default``."""
    key = _folded(col, fold, fold_accents)
    out = F.lit(default)
    for label, values in reversed(list(groups.items())):
        out = F.when(key.isin(*values), F.lit(label)).otherwise(out)
    return out


def public_columns(df: DataFrame) -> list[str]:
    """Column names that may be shown or used as features (no ``_`` prefix)."""
    return [c for c in df.columns if not c.startswith("_")]
