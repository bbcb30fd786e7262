"""Text functions against Python's own string methods."""

import re
import unicodedata

from pyspark.sql import functions as F

from reliefsignals import fixed_values as fv
from reliefsignals.functions import text as T

SPACED = ["  a  b ", " a　 b\x1c", "", " ", "a b c", "\n\na\tb\r\n", "a\x85b", "x​y", None]


def test_strip_and_collapse(one_column):
    assert one_column(T.strip, SPACED) == [None if s is None else s.strip() for s in SPACED]
    assert one_column(T.collapse_whitespace, SPACED) == [" ".join((s or "").split()) for s in SPACED]


def test_every_white_space_character_is_collapsed(one_column):
    every = [f"a{c}{c}b{c}c" for c in T.WHITE]
    assert set(one_column(T.collapse_whitespace, every)) == {"a b c"}


def test_fold_is_casefold(one_column):
    words = ["STRASSE", "Straße", "ΟΔΟΣ", "ς", "İLETİŞİM", "ı", "ſ", "µ", "ÇÖĞÜŞ", "K", "Ꮰ", None]
    assert one_column(T.fold, words) == [None if w is None else w.casefold() for w in words]


def test_fold_suspects_cover_every_single_folding():
    pattern = re.compile("[µſͅ-ϵᏸ-ᏽᲀ-ẛιꭰ-ꮿ]")
    assert all(pattern.match(c) for c in T._FOLD_FROM)


def test_fold_is_casefold_on_every_code_point(spark):
    """Compared in the JVM: one row per code point that either side changes."""
    points = [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000]
    rows = [(p, f"a{chr(p)}b", f"a{chr(p)}b".casefold()) for p in points if chr(p).casefold() != chr(p) or chr(p).lower() != chr(p)]
    table = spark.createDataFrame(rows, "p int, t string, f string").repartition(4)
    wrong = table.where(T.fold(F.col("t")) != F.col("f")).select("p").collect()
    assert [hex(r.p) for r in wrong] == []


def test_mojibake(one_column):
    def misread(s):
        return s.encode("utf-8").decode("latin-1")

    cases = {
        misread("Kahramanmaraş"): "Kahramanmaraş",
        "  Sanliurfa ": "Şanlıurfa",
        misread("Diyarbakır") + " ": "Diyarbakır",
        "Ã tek": "Ã tek",
        "Gaziantep �": "Gaziantep �",
        "Adıyaman": "Adıyaman",
        "Adiyaman": "Adıyaman",
        "Åı": "Åı",
        "": "",
    }
    assert one_column(T.fix_mojibake, [*cases, None]) == [*cases.values(), ""]


def test_unknown_places(one_column):
    tokens = [" N/A ", "Unknown", "<NA>", "NONE", "null", "NaN", "na", "", None]
    assert one_column(T.normalize_location, tokens) == [""] * len(tokens)
    assert one_column(T.normalize_location, ["Nana", "Hatay"]) == ["Nana", "Hatay"]


def test_nfc_on_every_code_point(spark):
    """Each character, alone and after a letter and a mark: suspects miss nothing."""
    from pyspark.sql import functions as F

    points = [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"]
    texts = [t for p in points for t in (chr(p), f"e{chr(p)}") if not unicodedata.is_normalized("NFC", t)]
    assert len(texts) > 1000
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfc(F.col("t")).alias("n")).collect()
    assert [r for r in rows if unicodedata.normalize("NFC", r.t) != r.n] == []


def test_clean_text(one_column):
    texts = ["é  a ", "가", "q̣̇", "plain", None]
    expected = [" ".join(unicodedata.normalize("NFC", t or "").split()) for t in texts]
    assert one_column(T.clean_text, texts) == expected


RULE_TEXTS = [
    "haber alamıyoruz, bilen var mı",
    "bilen var mı",
    "HABER  ALAMIYORUZ irtibat",
    "canlı yayın duyurusu",
    "CANLI YAYIN",
    "ulaşamıyorum numara 05551234567",
    "0٣٤٥٦٧٨٩٠١٢ duyan",
    "gören irtibata gecsin",
    "bılen ve ıletişim",
    "İLETİŞİM bilen",
    "ILETISIM BILEN",
    "dağıtım",
    "sadece su",
    "",
    None,
]


def test_info_rule_matches_regular_expressions(one_column):
    def expected(text):
        t = " ".join((text or "").casefold().split())
        m, r, c, a = (
            bool(re.search(p, t, re.IGNORECASE))
            for p in (fv.INFO_MISSING, fv.INFO_REQUEST, fv.INFO_CONTACT, fv.INFO_ANNOUNCEMENT)
        )
        return a or m + r + c >= 2

    assert one_column(T.info_signal, RULE_TEXTS) == [expected(t) for t in RULE_TEXTS]


def test_ellipsize(one_column):
    texts = ["a" * 140, "a" * 141, "ş" * 200]
    assert one_column(lambda c: T.ellipsize(c, 140), texts) == ["a" * 140, "a" * 137 + "...", "ş" * 137 + "..."]
