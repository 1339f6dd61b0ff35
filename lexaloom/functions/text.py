"""String functions, Column to Column. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that keep their final dot.
ABBREVIATIONS = [
    "i.e.", "u.s.", "u.s.a.", "e.g.", "ft.", "cf.", "etc.", "approx.",
    "al.", "no.", "vs.", "v.", "op.",
    "mr.", "ms.", "mrs.", "dr.", "ph.d.", "st.", "jr.", "sr.",
    "sgt.", "lt.", "maj.", "col.", "gen.",
    "a.m.", "p.m.",
    "corp.", "inc.", "ltd.", "bros.", "co.",
]

# Punctuation that is split off, for plain and for marked-up text.
PUNCTUATION = "!\"()*,:;<=>?[]{}.'"
PUNCTUATION_WIKI = "!\"()*,:;=?[]{}.'"

# Determiners, and punctuation that keeps one before it.
DETERMINERS = ["my", "our", "your", "their", "a", "an", "the", "her", "its", "his"]
CLOSING = ["[", "!", "(", ")", ",", ".", ":", ";", "?", "/", "\\", "]", "^", "`", "{", "|", "}"]

# Characters without a decomposition, and what stands for them.
PLAIN = {
    "‒": "-", "–": "-", "—": "-", "−": "-",
    "‘": "'", "’": "'", "“": '"', "”": '"',
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st",
    "�": "", " ": " ",
}

# Number patterns in the order of their replacement.
FLOAT = r"-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
INTEGER = r"\b[1-9][\d,]*\b"
NUMBER_CLASSES = [
    ("<NUM:AREA>", rf"\b{FLOAT}\s?(m2|square \w+)\b"),
    ("<NUM:VOL>", rf"\b{FLOAT}\s?(m3|cubic \w+)\b"),
    ("<NUM:GEO>", rf"{INTEGER}° {INTEGER}'"),
    ("<NUM:TEMP>", rf"{FLOAT}\s?(°C|Celsius|°F|Fahrenheit)"),
    ("<NUM:PERCENT>", rf"\b{FLOAT}%"),
    ("<NUM:INT>", INTEGER),
    ("<NUM:OTHER>", FLOAT),
]

# The type that stands for a recogniser's tag.
TAG_TYPES = [("<LOCATION>", "<dbpedia:Place>"), ("<PERSON>", "<dbpedia:Person>"), ("<ORGANISATION>", "<dbpedia:Organisation>"), ("<ORGANIZATION>", "<dbpedia:Organisation>")]

# The signs of the zodiac.
SIGNS = ["Aries", "Taurus", "Gemini", "Cancer", "Leo", "Virgo", "Libra", "Scorpio", "Sagittarius", "Capricorn", "Aquarius", "Pisces"]

ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c for c in chars) + "]"


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _peeled(token: Column, punctuation: str) -> Column:
    p = _class(punctuation)

    def rest_of(lead: Column, rest: Column) -> Column:
        def split_trail(trail: Column) -> Column:
            core = F.substr(rest, F.lit(1), F.length(rest) - F.length(trail))
            dotted = trail.startswith(".") & F.concat(F.lower(core), F.lit(".")).isin(ABBREVIATIONS)
            return F.concat(_chars(lead), F.array(F.when(dotted, F.concat(core, F.lit("."))).otherwise(core)), _chars(F.when(dotted, F.substr(trail, F.lit(2))).otherwise(trail)))

        whole = rest.rlike(r"^([A-Z]\.|\.\d)")
        return F.when(whole, F.concat(_chars(lead), F.array(rest))).otherwise(let(F.regexp_extract(rest, f"{p}*$", 0), split_trail))

    def from_lead(lead: Column) -> Column:
        number = lead.endswith(".") & F.substr(token, F.length(lead) + 1, F.lit(1)).rlike(r"\d")
        return let(F.when(number, F.substr(lead, F.lit(1), F.length(lead) - 1)).otherwise(lead), lambda x: let(F.substr(token, F.length(x) + 1), lambda rest: rest_of(x, rest)))

    return F.filter(let(F.regexp_extract(token, f"^{p}*", 0), from_lead), lambda t: t != "")


def tokenize(text: Column, punctuation: str = PUNCTUATION) -> Column:
    """Tokens: punctuation comes off both ends of words, but for abbreviations, initials and decimals."""
    return F.flatten(F.transform(words(text), lambda t: _peeled(t, punctuation)))


def wiki_tokenize(text: Column) -> Column:
    """As tokenize, with angle brackets left in words."""
    return tokenize(text, PUNCTUATION_WIKI)


def possessive_tokens(tokens: Column) -> Column:
    """Splits a final 's into a token."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t.endswith("'s"), F.array(F.substr(t, F.lit(1), F.length(t) - 2), F.lit("'s"))).otherwise(F.array(t))))


def camel_split(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(.)([A-Z][a-z]+)", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")


def number_classes(text: Column) -> Column:
    """Numbers replaced by their class, in a fixed order."""
    out = text
    for name, pattern in NUMBER_CLASSES:
        out = F.regexp_replace(out, pattern, name)
    return F.when(text.rlike(r"\d"), out).otherwise(text)


def strip_determiners(tokens: Column) -> Column:
    """Tokens without determiners; one before a punctuation mark stays."""
    return let(tokens, lambda ts: F.filter(ts, lambda t, i: ~F.lower(t).isin(DETERMINERS) | F.coalesce(F.try_element_at(ts, i + 2).isin(CLOSING), F.lit(False))))


def strip_adjectives(tagged: Column) -> Column:
    """array<struct<token, tag>> without runs of JJ that a noun follows; a run at the end goes too."""
    def kept(ts: Column) -> Column:
        rest = lambda i: F.filter(F.slice(ts, i + 1, F.size(ts)), lambda u: u["tag"] != "JJ")
        return F.filter(ts, lambda t, i: (t["tag"] != "JJ") | let(rest(i), lambda r: (F.size(r) > 0) & ~F.try_element_at(r, F.lit(1))["tag"].startswith("NN")))

    return let(tagged, kept)


def plain_characters(text: Column) -> Column:
    single = {k: v for k, v in PLAIN.items() if len(v) == 1}
    out = F.translate(text, "".join(single) + "�", "".join(single.values()))
    for k, v in PLAIN.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def sentences(text: Column) -> Column:
    """Sentences of spaced tokens, each ending in ` .`; an unfinished last one is dropped."""
    kept = let(F.split(text, r"\s[.?!]\s(?=[^a-z])"), lambda parts: F.filter(parts, lambda s, i: (F.trim(s) != "") & ((i < F.size(parts) - 1) | s.endswith("."))))
    return F.transform(kept, lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(" ."))))


# What each kind of wiki markup looks like within a line, outer kinds first; all of it goes.
WIKI_MARKUP = {
    "template": r"(?s)\{\{.+\}\}",
    "embedded file or category": r"(?s)\[\[(File|Category):.+\]\]",
    "comment": r"(?s)(<!--|<s>).+(-->|</s>)",
    "target before a link's text": r"[\w\s():#-]+\|",
    "link": r"\[\[|\]\]",
    "emphasis": r"'{2,5}",
    "heading": r"^={1,6}|={1,6}$",
}


def _plain_line(line: Column) -> Column:
    for pattern in WIKI_MARKUP.values():
        line = F.regexp_replace(line, pattern, "")
    stars = F.length(F.regexp_extract(line, r"^\*+", 0))  # a list item's depth becomes its indent
    return F.when(stars > 0, F.concat(F.repeat(F.lit(" "), stars - 1), F.lit("*"), F.substr(line, stars + 1))).otherwise(line)


def without_wiki_markup(text: Column) -> Column:
    """Text without markup that isn't shown, line by line."""
    return F.array_join(F.transform(F.split(text, r"(?<=\n)"), _plain_line), "")


def history_text(text: Column) -> Column:
    """Line breaks as full stops, white space squeezed, printable characters only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", ". "), r"[^\x20-\x7E]", ""), r"\s+", " "))


def without_tags(text: Column, keep: str, remove: str) -> Column:
    """Drops the elements of one tag with their content and the marks of another."""
    return F.regexp_replace(F.regexp_replace(text, f"<{remove}>.*?</{remove}>", ""), f"</?{keep}>", "")


def html_unescape(text: Column) -> Column:
    for code, char in ENTITIES:
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


LINK_TAG = r"<([^\s]+?)\|([^\s]+?)>"


def link_tags(text: Column) -> Column:
    """array<struct<uri, anchor>> of the `<uri|anchor>` tags, first letters of uris in upper case."""
    whole = F.regexp_extract_all(text, F.lit(LINK_TAG), F.lit(0))

    def parts(tag: Column) -> Column:
        uri = F.regexp_extract(tag, LINK_TAG, 1)
        return F.struct(F.concat(F.upper(F.substr(uri, F.lit(1), F.lit(1))), F.substr(uri, F.lit(2))).alias("uri"), F.replace(F.regexp_extract(tag, LINK_TAG, 2), F.lit("_"), F.lit(" ")).alias("anchor"))

    return F.transform(whole, parts)


def link_text(text: Column) -> Column:
    """The text with each tag replaced by its anchor."""
    return F.replace(F.regexp_replace(text, LINK_TAG, "$2"), F.lit("_"), F.lit(" "))


def type_of_tag(tag: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in TAG_TYPES:
        out = F.when(tag == name, kind).otherwise(out)
    return out


def replace_types(text: Column) -> Column:
    """Tagged entities replaced by their types."""
    for name, kind in TAG_TYPES:
        text = F.regexp_replace(text, rf"{name}.+?</[A-Z]+>", kind)
    return text


def replace_entities(text: Column) -> Column:
    """Tagged entities replaced by their opening tags."""
    return F.regexp_replace(text, r"(<[A-Z]+?>)\S.*?</[A-Z]+?>\S*", "$1")


def strip_hash(text: Column) -> Column:
    return F.replace(text, F.lit(" #"), F.lit(" "))


def context(text: Column, start: Column, end: Column) -> Column:
    """The two tokens before and after a span, NONE where there are fewer: five tokens with NONE in the middle."""
    none = F.array(F.lit("NONE"), F.lit("NONE"))
    before = F.concat(none, wiki_tokenize(replace_types(F.substr(text, F.lit(1), start))))
    after = F.concat(wiki_tokenize(replace_types(F.substr(text, end + 1))), none)
    return F.concat(F.slice(before, -2, 2), F.array(F.lit("NONE")), F.slice(after, 1, 2))


def tweet_entities(text: Column) -> Column:
    """array<struct<text, start, end, word>> of handles and hashtags: offsets without the mark, and the word's number."""
    marks = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(2)).rlike(r"^[@#]\w"))

    def one(i: Column) -> Column:
        name = F.regexp_extract(F.substr(text, i + 1), r"^[\w_]+", 0)
        before = F.substr(text, F.lit(1), i - 1)
        return F.struct(name.alias("text"), i.alias("start"), (i + F.length(name)).alias("end"), (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).alias("word"))

    return F.transform(marks, one)


def label_of_uri(uri: Column) -> Column:
    return F.trim(F.replace(F.substring_index(F.substring_index(uri, ",", 1), "(", 1), F.lit("_"), F.lit(" ")))


def person_labels(label: Column) -> Column:
    """All ordered sub-combinations of a name's words, of which a name of n words has 2^n - 1: each word joins those made before it."""
    kind = "array<string>"
    made = F.aggregate(words(label), F.array(F.lit("")), lambda acc, w: F.concat(acc, F.transform(acc, lambda x: F.when(x == "", w).otherwise(F.concat(x, F.lit(" "), w)))))
    return F.array_distinct(F.filter(made.cast(kind), lambda x: x != ""))


def label_variant(label: Column, *, lower: bool = False, spaces: bool = True) -> Column:
    label = F.lower(label) if lower else label
    return label if spaces else F.replace(label, F.lit(" "), F.lit(""))


def unquote(text: Column) -> Column:
    """Percent decoding that leaves plus signs alone; text that isn't valid stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def title_case(text: Column) -> Column:
    """Upper case after every non-letter."""
    return F.array_join(F.transform(F.split(text, "(?<=[^A-Za-z])|(?=[^A-Za-z])"), lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & text.rlike("[A-Z]")


def is_lower(text: Column) -> Column:
    return (F.lower(text) == text) & text.rlike("[a-z]")


def astrology_uri(mention: Column, uri: Column) -> Column:
    """The astrological article for a sign's name or plural."""
    name = title_case(mention)
    single = F.when(name.isin(SIGNS), name).when(F.regexp_replace(name, "s$", "").isin(SIGNS), F.regexp_replace(name, "s$", ""))
    return F.coalesce(F.concat(single, F.lit("_(astrology)")), uri)


def string_similar(mention: Column, uri: Column) -> Column:
    """A common word, or the mention within the uri's words."""
    return F.arrays_overlap(words(F.lower(mention)), F.split(F.lower(uri), "_")) | F.contains(F.replace(uri, F.lit("_"), F.lit(" ")), mention)


def sentence_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^[\s\"']+|[\s\"']+$", ""), r"\s*'s\b", "")


def edit_token(token: Column) -> Column:
    """A lower-cased token with number classes; a full stop is a comma."""
    return F.when(token == ".", F.lit(",")).otherwise(number_classes(F.lower(token)))


def compressed_pos(tag: Column) -> Column:
    return F.when(tag.startswith("VB"), F.lit("VB")).when(tag == "NNS", F.lit("NN")).otherwise(tag)


def edit_cell(text: Column) -> Column:
    """A version's text: no asterisks, repeated marks and spaces once; empty, `null` or broken over lines: null."""
    t = F.trim(text)
    out = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("*"), F.lit("")), r"([.!?-]){2,}", "$1"), "( ){2,}", "$1")
    return F.when(~F.contains(t, F.lit("\n")) & (out != "") & (out != "null"), out)


def is_garbage_edit(a: Column, b: Column) -> Column:
    """Both empty, equal but for case, or with a character that is neither word nor space."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (F.lower(a) == F.lower(b)) | a.rlike(r"[^\w\s]") | b.rlike(r"[^\w\s]")


def segmentations(tokens: Column, max_length: int = 5, last: int = 5, most_words: int = 10) -> Column:
    """array<array<string>>: the ways to cut up to most_words words in two or more parts, none but the last of
    max_length words or more, the last of `last` at most. One word gives itself; longer texts null."""
    n = F.size(tokens)
    masks = F.sequence(F.lit(1), F.lit((1 << (most_words - 1)) - 1))
    ok = F.filter(masks, lambda m: m < F.pow(F.lit(2), n - 1))

    def cut(m: Column) -> Column:
        marked = F.transform(tokens, lambda w, i: F.concat(F.when((i > 0) & (F.pmod(F.floor(m / F.pow(F.lit(2), i - 1)), F.lit(2)) == 1), F.lit("\x01")).when(i > 0, F.lit(" ")).otherwise(F.lit("")), w))
        return F.split(F.array_join(marked, ""), "\x01")

    sized = F.filter(F.transform(ok, cut), lambda parts: F.forall(parts, lambda p: (F.size(F.split(p, " ")) < max_length) | (p == F.element_at(parts, -1))) & (F.size(F.split(F.element_at(parts, -1), " ")) <= last) & F.forall(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.size(F.split(p, " ")) < max_length))
    return F.when(n == 1, F.array(tokens)).when((n > 1) & (n <= most_words), sized)
