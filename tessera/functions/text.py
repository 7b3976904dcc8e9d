"""Column functions: normalising, parsing and rewriting text. All are builtin expressions; null stays null unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that stand for no value (fixed values).
PLACEHOLDERS = ("", "  ", "、", "ー", "－", "―", "-")
#: Single characters that are folded (fixed values).
FOLD_FROM = "１Ｘ＋：＆！’，　"
FOLD_TO = "1X+:&!', "
#: Brackets before whose closing half no blank stands (fixed values).
CLOSING = "」】\\]］”"
#: A record code: prefix, set number, card number. The class holds a literal bar.
CODE = r"[A-Z|0-9]+-[0-9]+"
#: Where a word of ASCII ends. `\b` isn't it: up to Java 18 it takes all letters of Unicode for parts of words, from 19 on ASCII's.
WORD_END = "(?![a-zA-Z0-9_])"


def normalize_text(c: Column) -> Column:
    """Placeholders to null, widths, quotes and blanks folded; brackets follow the wide ones where a text has these."""
    # placeholders go first: inside a condition, an expression that is used several times is computed as often
    s = F.when(~c.isin(*PLACEHOLDERS), c)
    folds = reduce(lambda a, b: a | b, [s.contains(x) for x in FOLD_FROM])  # a pattern takes much longer, and longest of all where none is there
    s = F.when(folds, F.translate(s, FOLD_FROM, FOLD_TO)).otherwise(s)
    s = F.regexp_replace(s, r"\h{2,}|[\h&&[^ ]]", " ")  # a single space stays, and isn't written again
    wide = s.contains("（") | s.contains("）")
    s = F.when(wide, F.translate(s, "()", "（）")).otherwise(s)
    square = s.contains("［") | s.contains("］")
    s = F.when(square, F.translate(s, "[]", "［］")).otherwise(s)
    return F.regexp_replace(s, rf"\s+(?=[{CLOSING}.])", "")


def apply_fixes(c: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """("literal" | "regex", what, with) rules in order."""

    def fix(s: Column, rule: tuple[str, str, str]) -> Column:
        kind, what, with_ = rule
        if kind not in ("literal", "regex"):
            raise ValueError(f"unknown kind of rule: {kind}")
        return F.replace(s, F.lit(what), F.lit(with_)) if kind == "literal" else F.regexp_replace(s, what, with_)

    return reduce(fix, rules, c)


def repair_markup(c: Column, words: Sequence[str]) -> Column:
    """`<Word ...>` of these words is text whose brackets weren't encoded."""
    return F.regexp_replace(c, rf"<((?:{'|'.join(words)})[^<>＞]*)[>＞]", "&lt;$1&gt;")


def clean_code(c: Column) -> Column:
    """A code without what follows a blank or a variant suffix."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\s.*$", ""), r"_P[0-9]+$", "")


def find_code(c: Column) -> Column:
    """The first code in a text, null where there is none."""
    return F.nullif(F.regexp_extract(c, CODE, 0), F.lit(""))


def code_parts(c: Column) -> Column:
    """P5: prefix, set and card number of a code; XXX and the largest long stand for what is missing, so that it sorts last."""
    long = lambda i, p: F.coalesce(F.regexp_extract(c, p, i).try_cast("long"), F.lit(2**63 - 1))
    prefix = F.coalesce(F.nullif(F.regexp_extract(c, r"^([A-Za-z]+)", 1), F.lit("")), F.lit("XXX"))
    return F.struct(prefix.alias("prefix"), long(1, r"^[A-Za-z]+([0-9]+)").alias("set_number"), long(1, r"([0-9]+)$").alias("card_number"))


def map_label(c: Column, labels: Mapping[str, str], part: str = "main") -> Column:
    """A localised label to its enum value. In "a/b" the main record has a, its dual has b."""
    halves = F.split(c, "/")
    own = F.element_at(halves, 1) if part == "main" else F.try_element_at(halves, F.lit(2))
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(table[c] if part == "main" else F.lit(None).cast("string"), table[F.trim(own)])


def first_int(c: Column) -> Column:
    """The first run of digits."""
    return F.regexp_extract(c, r"([0-9]+)", 1).try_cast("long")


def level_cost(c: Column) -> Column:
    """Level after "Lv." and the first number that isn't one."""
    rest = F.regexp_replace(c, r"(?i)lv\.?\s*[0-9]+", "")
    return F.struct(F.regexp_extract(c, r"(?i)lv\.?\s*([0-9]+)", 1).try_cast("long").alias("level"), first_int(rest).alias("cost"))


def cost_columns(category: Column, cost: Column, use_categories: Sequence[str], free: Column) -> Column:
    """A cost is a use cost in some categories and a play cost in others; free ones without a cost cost 0."""
    value = F.coalesce(cost, F.when(free, F.lit(0)).cast("long"))
    use = category.isin(*use_categories)
    return F.struct(F.when(~use, value).alias("play_cost"), F.when(use, value).alias("use_cost"))


def swapped(a: Column, b: Column, values: Sequence[str]) -> Column:
    """(a, b), the other way round where b holds one of a's values."""
    wrong = F.coalesce(b.isin(*values) & a.isNotNull(), F.lit(False))
    return F.struct(F.when(wrong, b).otherwise(a).alias("a"), F.when(wrong, a).otherwise(b).alias("b"))


def route_text(text: Column, language: Column, prefixes: Mapping[str, str]) -> Column:
    """P10: a lower text is a security effect if it begins with its language's prefix, else an inherited one."""
    table = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    security = F.coalesce(text.startswith(table[language]), F.lit(False))
    return F.struct(F.when(security, text).alias("security_effect"), F.when(~security, text).alias("inherited_effect"))


def expand_colors(colors: Column, every: Sequence[str], word: str = "all") -> Column:
    """Blanks removed, and `word` stands for all colours."""
    full = F.array(*[F.lit(x) for x in every])
    clean = F.filter(F.transform(colors, lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x != "")
    return F.flatten(F.transform(clean, lambda x: F.when(x == word, full).otherwise(F.array(x))))


def parse_requirement(c: Column, forms: Sequence[str], colors: Sequence[str]) -> Column:
    """Cost, level, form and colours of a requirement such as "Red or Blue Lv.4 Super: Cost 3"."""
    found = lambda words: F.nullif(F.regexp_extract(c, rf"\b({'|'.join(words)})\b", 1), F.lit(""))
    return F.struct(
        F.regexp_extract(c, r"(?i)cost\s*([0-9]+)", 1).try_cast("long").alias("cost"),
        F.regexp_extract(c, r"(?i)lv\.?\s*([0-9]+)", 1).try_cast("long").alias("level"),
        found(forms).alias("form"), F.array_distinct(F.regexp_extract_all(c, F.lit(rf"\b({'|'.join(colors)})\b"), 1)).alias("colors"),
    )


def fill_from_first(rows: Column) -> Column:
    """Rows of an array without a level or cost take the first row's."""
    first = F.try_element_at(rows, F.lit(1))
    return F.transform(rows, lambda r: r.withField("level", F.coalesce(r["level"], first["level"])).withField("cost", F.coalesce(r["cost"], first["cost"])))


def variant_id(c: Column, alternate: Column | None = None) -> Column:
    """The number after _P before the extension; 0 without one, null for an unnumbered alternate."""
    own = F.regexp_extract(c, r"_P([0-9]+)(?:\.|$)", 1).try_cast("long")
    return F.coalesce(own, F.when(alternate if alternate is not None else F.lit(False), F.lit(None)).otherwise(F.lit(0)).cast("long"))


def normalize_release(c: Column) -> Column:
    """Blanks folded, and set codes in brackets written [BT-01]."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    s = F.regexp_replace(s, r"\[([A-Z]+)-?([0-9])\]", "[$1-0$2]")
    return F.regexp_replace(s, r"\[([A-Z]+)-?([0-9]{2,})\]", "[$1-$2]")


def bracket_refs(c: Column) -> Column:
    """All set codes in brackets."""
    return F.regexp_extract_all(c, F.lit(r"\[([A-Z]+-?[0-9]+)\]"), 1)


#: Date patterns in the order they are tried (P16), after ordinals are stripped.
DATES = {
    "en": ("MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy", "yyyy-MM-dd"), "ja": ("yyyy年M月d日", "yyyy年M月", "yyyy.M.d", "yyyy-MM-dd"),
    "zh-Hans": ("yyyy年M月d日", "yyyy年M月", "yyyy-MM-dd"), "ko": ("yyyy년 M월 d일", "yyyy년 M월", "yyyy.M.d", "yyyy-MM-dd"),
}


def parse_date(c: Column, language: str) -> Column:
    """The first pattern that fits; a missing day is the first."""
    s = F.trim(F.regexp_replace(c, r"([0-9])(?:st|nd|rd|th)\b", "$1"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in DATES[language]])


def iso_date(c: Column) -> Column:
    """P17."""
    return F.date_format(c, "yyyy-MM-dd")


def rewrite_uri(c: Column, base: str, moves: Mapping[str, str]) -> Column:
    """Query and fragment stripped, relative resolved, prefixes moved, .png to .webp."""
    s = F.regexp_replace(c, r"[?#].*$", "")
    s = F.when(s.rlike(r"^[a-z]+://"), s).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(s, r"^(\.?/)+", "")))
    for old, new in moves.items():
        s = F.when(s.startswith(old), F.concat(F.lit(new), F.substring(s, len(old) + 1, 1 << 20))).otherwise(s)
    return F.regexp_replace(s, r"\.png$", ".webp")


#: P19, fixed values: Latin letters of kana in the order of their code points from U+3041 on; "~" joins a small sign to the one
#: before it, "^" doubles the next consonant.
KANA = (
    "~a a ~i i ~u u ~e e ~o o ka ga ki gi ku gu ke ge ko go sa za shi ji su zu se ze so zo ta da chi ji ^ tsu zu te de to do na ni nu ne no "
    "ha ba pa hi bi pi fu bu pu he be pe ho bo po ma mi mu me mo ~ya ya ~yu yu ~yo yo ra ri ru re ro ~wa wa wi we wo n vu ka ke"
).split()
#: P19, fixed values: the parts of a Hangul syllable in Latin letters, in the order that its code point counts them.
HANGUL_INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
HANGUL_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
HANGUL_FINALS = "- g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h".replace("-", "").split(" ")
_FIRST_KANA, _FIRST_HANGUL, _LAST_HANGUL = 0x3041, 0xAC00, 0xD7A3
_HIRAGANA = "".join(chr(_FIRST_KANA + i) for i in range(len(KANA)))
_KATAKANA = "".join(chr(ord(x) + 0x60) for x in _HIRAGANA)


def transliterate(c: Column) -> Column:
    """Kana and Hangul syllables in Latin letters, all else as it is. Long vowels count once, doubled consonants twice."""

    def letter(x: Column) -> Column:
        code = F.ascii(x)
        at = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)
        syllable = code - _FIRST_HANGUL
        hangul = F.concat(at(HANGUL_INITIALS, F.floor(syllable / 588)), at(HANGUL_VOWELS, F.floor(syllable % 588 / 28)), at(HANGUL_FINALS, syllable % 28))
        kana = at(KANA, code - _FIRST_KANA)
        return F.when(code.between(_FIRST_HANGUL, _LAST_HANGUL), hangul).when(code.between(_FIRST_KANA, _FIRST_KANA + len(KANA) - 1), kana).otherwise(x)

    s = F.translate(F.translate(c, _KATAKANA, _HIRAGANA), "~^ー", "--")
    s = F.array_join(F.transform(F.split(s, ""), letter), "")
    s = F.regexp_replace(F.regexp_replace(s, "(sh|ch|j)i~y", "$1"), "i~y", "y")
    s = F.regexp_replace(F.replace(F.regexp_replace(s, "[aeiou]~([aeiou])", "$1"), F.lit("~"), F.lit("")), r"\^ch", "tch")
    return F.replace(F.regexp_replace(s, r"\^([b-df-hj-np-tv-z])", "$1$1"), F.lit("^"), F.lit(""))


def slugify(c: Column) -> Column:
    """The bracketed set code if there is one, else the name, with a version; Latin letters folded, kana and Hangul
    transliterated, all else hyphens. Chinese characters, whose letters no rule of moderate size tells, are hyphens, too."""
    code = F.nullif(F.regexp_extract(c, r"\[([A-Za-z]+-?[0-9]+)\]", 1), F.lit(""))
    version = F.nullif(F.regexp_extract(c, r"(?i)\bv(?:er)?\.?\s*([0-9]+\.[0-9]+)", 1), F.lit(""))
    s = F.concat_ws(" ", F.coalesce(code, c), F.when(code.isNotNull() & version.isNotNull(), F.concat(F.lit("v"), version)))
    s = F.translate(F.lower(s), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    s = F.when(s.rlike("[\u3041-\u30fc\uac00-\ud7a3]"), transliterate(s)).otherwise(s)
    return F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9.]+", "-"), r"^-+|-+$", "")


def fingerprint(*columns: Column) -> Column:
    """P20: SHA-1 of the values as JSON."""
    return F.sha1(F.to_json(F.struct(*columns)))


def clean_notes(lines: Column) -> Column:
    """Lines trimmed, marker glyphs and empty lines dropped, brackets unified, joined by single newlines."""
    one = lambda x: F.trim(F.regexp_replace(F.translate(x, "[]", "［］"), r"^\s*[▼※■]\s*", ""))
    return F.array_join(F.filter(F.transform(lines, one), lambda x: x != ""), "\n")


def compact_json(value: Column) -> Column:
    """Nulls are left out."""
    return F.to_json(value)


def split_markers(text: Column, markers: Sequence[str], quoted: str = r"\"([^\"]+)\"") -> Column:
    """P25: cut text at the first of each marker, from the last marker of the list's place backwards: an array of
    (marker, values, before), where values are the quoted parts between a marker and the cut before, and `before` is the text that was
    left when the marker was looked for. Markers that a cut removed are gone.
    """
    start = F.struct(text.alias("rest"), F.expr("cast(array() as array<struct<marker:string,values:array<string>,before:string>>)").alias("out"))

    def cut(acc: Column, marker: Column) -> Column:
        at = F.call_function("instr", acc["rest"], marker)
        tail = F.call_function("substring", acc["rest"], at)
        row = F.struct(marker.alias("marker"), F.array_distinct(F.regexp_extract_all(tail, F.lit(quoted), 1)).alias("values"), acc["rest"].alias("before"))
        found = at > 0
        return F.struct(
            F.when(found, F.call_function("substring", acc["rest"], F.lit(1), at - 1)).otherwise(acc["rest"]).alias("rest"),
            F.when(found, F.concat(F.array(row), acc["out"])).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(F.array(*[F.lit(m) for m in markers]), start, cut)["out"]


#: Pairs of brackets around tokens, for all languages and by language (fixed values).
BRACKETS = ("【】", "[]", "〔〕", "［］", "{}", "≪≫", "〈〉", "《》", "＜＞", "⟨⟩")
OWN_BRACKETS = {"zh-Hans": ("「」", "｢｣", "“”"), "en": ("<>", "“”"), "ja": ("<>", "「」", "｢｣"), "ko": ("<>", "「」", "｢｣")}
#: A pattern that finds any opening bracket: a text without one has no tokens.
OPENING = "[" + "".join(sorted({rf"\{pair[0]}" for pair in (*BRACKETS, *(p for own in OWN_BRACKETS.values() for p in own))})) + "]"
#: Kind of a token by its opening bracket (fixed values); English brackets other than these need a learned kind.
KINDS = {"“": "mention", "「": "mention", "｢": "mention", "【": "timing", "〔": "timing", "[": "precondition", "［": "precondition", "{": "precondition",
         "<": "keyword-effect", "≪": "keyword-effect", "〈": "keyword-effect", "《": "keyword-effect", "＜": "keyword-effect"}
ENGLISH = {k: v for k, v in KINDS.items() if v == "keyword-effect" or k == "{"}
#: Words that settle a token's kind in any language (fixed values).
NAMED = (
    ("digixros", ("デジクロス", "DigiXros", "数码合体", "디지크로스")), ("overflow", ("オーバーフロー", "Overflow", "溢出", "오버플로우")),
    ("arts-digivolve", ("アーツ進化", "Arts Digivolve", "技艺进化")), ("precondition", ("Once Per Turn",)), ("timing", ("Your Turn",)),
)
WHOLE = (("link", r"^.(?:リンク|Link|链接).$"), ("assembly", r"^.(?:アセンブリ-|Assembly\s-|组装-)[0-9].$"), ("rule", r"^.(?:ルール|Rule|规则|룰|규칙).$"))


def token_pattern(language: str) -> str:
    pairs = (*BRACKETS, *OWN_BRACKETS.get(language, ()))
    return "|".join(rf"\{o}[^\{c}]+\{c}+" if o in "[{" else f"{o}[^{c}]+{c}+" for o, c in pairs)


def token_kind(token: Column, language: str) -> Column:
    kind = None
    for name, words in NAMED:
        test = reduce(lambda a, b: a | b, [token.contains(w) for w in words])
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    for name, pattern in WHOLE:
        kind = kind.when(token.rlike(pattern), name)
    table = dict(ENGLISH if language == "en" else KINDS)
    if language == "ko":
        table["〔"] = "precondition"
    if language == "zh-Hans":
        table.pop("<")
    first = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return kind.otherwise(first[F.substring(token, 1, 1)])


def _tokens_of(text: Column, language: str) -> Column:
    stop = r"。.$" if language in ("ja", "zh-Hans") else r"\..$"
    rows = F.transform(F.regexp_extract_all(text, F.lit(token_pattern(language)), 0), lambda t: F.struct(t.alias("text"), token_kind(t, language).alias("kind")))

    def prose(r: Column) -> Column:
        ends = r["text"].rlike(stop)
        return F.coalesce(r["kind"] == "mention", F.lit(True)) & (ends | r["text"].contains(",") if language == "zh-Hans" else ends)

    return F.transform(F.filter(rows, lambda r: ~prose(r)), lambda r, i: F.struct(i.alias("index"), r["text"].alias("text"), r["kind"].alias("kind")))


def extract_tokens(text: Column, language: Column, languages: Sequence[str] = ("ja", "en", "zh-Hans", "ko")) -> Column:
    """Bracketed tokens of a text in order, with their index and kind. Mentions and unknown ones that end a sentence are dropped."""
    out = F.when(language == languages[0], _tokens_of(text, languages[0]))
    for name in languages[1:]:
        out = out.when(language == name, _tokens_of(text, name))
    return out


def rank_of(c: Column, levels: Sequence[str]) -> Column:
    """Place of an ordered enum's value, from 0; null for other values."""
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), c)
    return F.when(at > 0, (at - 1).cast("int"))
