"""Text cleaning as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reliefsignals import fixed_values as fv

# Unicode white space as str.split() sees it; a regex "\\s" knows only the ASCII part.
WHITE = "".join(chr(p) for p in range(0x3001) if chr(p).isspace())

# The same set as a character class; the intersection lets letters leave at the first test.
_WHITE_CLASS = (
    r"[\x00-\x20\x7f-\uffff&&"
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)

# Superset of the characters NFC can change: combining marks, Hangul jamo, and the
# blocks with canonical singletons.  Composed Turkish or Latin letters are not in it.
NFC_SUSPECTS = (
    r"[[^\x00-\u02ff]&&[\p{M}\u0374\u037e\u0387\u0958-\u095f\u09dc-\u09df\u0a33-\u0a5e\u0b5c-\u0b5d"
    r"\u0f43-\u0fb9\u1100-\u11ff\u1f00-\u1fff\u2000\u2001\u2126\u212a\u212b\u2329\u232a"
    r"\u2adc\uf900-\ufaff\ufb1d-\ufb4f\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1f}]]"
)

# Differences between case folding and lower case, found from the rule itself: one letter
# for one, and about a hundred letters that become several.
_FOLDS = {
    chr(p): chr(p).casefold()
    for p in range(0x80, 0x10000)
    if chr(p).lower() == chr(p) != chr(p).casefold()
}
_LONG_FOLDS = {c: f for c, f in _FOLDS.items() if len(f) > 1}
_FOLD_FROM = "".join(c for c in _FOLDS if c not in _LONG_FOLDS)
_FOLD_TO = "".join(f for c, f in _FOLDS.items() if c not in _LONG_FOLDS)
# Superset of the one-letter folds in few ranges; the translation leaves the others.
_FOLD_SUSPECTS = (
    r"[\x7f-\uffff&&[\u00b5\u017f\u0345-\u03f5\u13f8-\u13fd\u1c80-\u1e9b\u1fbe\uab70-\uabbf]]"
)
# The sharp s is common and replaced without a test; texts with another one are few. The range
# lets most characters leave at the first test, for single ones are tested one by one.
_LONG_SUSPECTS = r"[\u0149-\uffff&&[" + "".join(c for c in _LONG_FOLDS if c != "ß") + "]]"


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def collapse_whitespace(c: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends; null is ''."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{_WHITE_CLASS}+", " "))


def fold(c: Column) -> Column:
    """Case-folded text for caseless comparison, as full Unicode folding gives it."""
    low = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    short = F.when(low.rlike(_FOLD_SUSPECTS), F.translate(low, _FOLD_FROM, _FOLD_TO)).otherwise(low)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _LONG_FOLDS.items()])
    long = F.aggregate(pairs, short, lambda text, pair: F.replace(text, pair["a"], pair["b"]))
    return F.when(low.rlike(_LONG_SUSPECTS), long).otherwise(short)


def fix_mojibake(c: Column) -> Column:
    """Strip, undo UTF-8-read-as-Latin-1 damage, and apply the place spellings.

    A text is re-decoded only if it has a tell-tale mark, all its characters fit
    Latin-1 and the bytes are valid UTF-8; otherwise it is kept.  Null becomes ''.
    """
    text = strip(F.coalesce(c, F.lit("")))
    damaged = text.rlike(f"[{''.join(fv.MOJIBAKE_MARKS)}]") & ~text.rlike(r"[^\x00-\xff]")
    decoded = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    repaired = F.when(damaged, F.coalesce(decoded, text)).otherwise(text)
    respelled = F.create_map(*[F.lit(x) for pair in fv.PROVINCE_FIXUPS.items() for x in pair])
    return F.when(repaired.isin(*fv.PROVINCE_FIXUPS), F.try_element_at(respelled, repaired)).otherwise(
        repaired
    )


def blank_unknown(text: Column) -> Column:
    """Replace the tokens that mean "unknown place" by ''."""
    # The tokens are plain ASCII, for which lower case and case folding agree.
    return F.when(F.lower(text).isin(*fv.UNKNOWN_PLACES), F.lit("")).otherwise(text)


def normalize_location(c: Column) -> Column:
    """Repaired place name, '' when unknown."""
    return blank_unknown(fix_mojibake(c))


def nfc(c: Column) -> Column:
    """NFC form.  Spark has no such function, so suspects - and only they - go to Python."""

    # Nested, so that it travels to the workers by value and they need no package.
    @F.pandas_udf(StringType())
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    suspect = F.when(c.rlike(NFC_SUSPECTS), c)
    return F.coalesce(compose(suspect), c)


def clean_text(c: Column, *, compose: bool = True) -> Column:
    """Model input text: NFC (unless ``compose=False``) and collapsed white space."""
    text = F.coalesce(c, F.lit(""))
    return collapse_whitespace(nfc(text) if compose else text)


def rule_text(c: Column, *, compose: bool = False) -> Column:
    """Text as the information rule reads it: folded, single blanks, dotless i as i.

    In this form caseless search and plain search find the same, and the plain one is
    several times faster.
    """
    text = F.coalesce(c, F.lit(""))
    return F.replace(collapse_whitespace(fold(nfc(text) if compose else text)), F.lit("ı"), F.lit("i"))


def _search(text: Column, pattern: str) -> Column:
    """Search a fixed rule pattern.  Its alternatives all start with a plain letter or
    digit; looking for one of those first halves the time."""
    starts = "".join(sorted({alternative[0] for alternative in pattern.strip("()").split("|")}))
    return text.rlike(f"(?U)(?=[{starts}]){pattern}")


def matches_info_rule(text: Column) -> Column:
    """True for an announcement, or for any two of missing-person, request and contact words.

    Each pattern is searched at most once.
    """
    families = (fv.INFO_MISSING, fv.INFO_REQUEST, fv.INFO_CONTACT)
    missing, request, contact = (_search(text, p).cast("int") for p in families)
    return _search(text, fv.INFO_ANNOUNCEMENT) | (missing + request + contact >= 2)


def info_signal(c: Column, *, compose: bool = False) -> Column:
    """True for texts that ask for, or announce, information about people."""
    return matches_info_rule(rule_text(c, compose=compose))


def ellipsize(c: Column, width: int) -> Column:
    """Cut texts longer than ``width`` and mark the cut with three dots."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)
