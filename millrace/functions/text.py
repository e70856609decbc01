"""Scalar functions as columns: keys, slugs, URLs, formats. No user-defined functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading articles that names are compared without, words for no fee, right-to-left languages.
ARTICLES = ["a", "az", "the", "die", "le", "la", "el", "los", "las"]
FREE_WORDS = ["ingyenes", "free", "gratis", "kostenlos", "gratuit"]
RTL = ["ar", "fa", "he", "ur"]
# Language tags and country codes of search services by locale, schema.org types by topic.
SEARCH_LANGUAGE = {"hu": "hu-HU", "en": "en-US", "de": "de-DE", "fr": "fr-FR", "es": "es-ES"}
SEARCH_COUNTRY = {
    "en": "US", "de": "DE", "fr": "FR", "es": "ES", "it": "IT", "pt": "BR", "nl": "NL", "sv": "SE", "da": "DK", "fi": "FI",
    "no": "NO", "pl": "PL", "tr": "TR", "ar": "SA", "zh": "CN", "ja": "JP", "ko": "KR", "ru": "RU",
}
TOPIC_TYPE = {
    "running": "SportsClub", "cycling": "SportsClub", "hiking": "SportsClub", "swimming": "SportsClub", "yoga": "SportsClub",
    "martial_arts": "SportsClub", "fitness": "SportsClub", "choir": "MusicGroup", "music": "MusicGroup", "dance": "DanceGroup",
    "theater": "PerformingGroup",
}
# Named entities that are decoded, the ampersand last.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&reg;": "®", "&middot;": "·",
    "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&euro;": "€", "&amp;": "&",
}


#: What counts as white space at the ends of a text.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(BLANKS))


def norm_key(text: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def record_key(name: Column, city: Column, topic: Column) -> Column:
    return F.concat_ws("|", norm_key(name), norm_key(city), norm_key(topic))


def sha_prefix(text: Column, size: int) -> Column:
    return F.substr(F.sha2(text, 256), F.lit(1), F.lit(size))


def url_hash(url: Column) -> Column:
    return sha_prefix(url, 16)


def community_id(name: Column, city: Column) -> Column:
    return sha_prefix(F.concat_ws("|", F.lower(name), F.lower(city)), 12)


@cache
def _decompositions() -> dict[str, str]:
    """What compatibility decomposition leaves of each character in ASCII, where that is something."""
    found = ((chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0x80, 0x110000))
    return {c: plain for c, plain in found if plain}


def to_ascii(text: Column) -> Column:
    """Letters and digits of all scripts that have an ASCII form, without their marks; the rest goes.

    Plain ASCII is not touched; the few texts with characters that become several (such as ligatures) go letter by letter.
    """
    found = _decompositions()
    single = {k: v for k, v in found.items() if len(v) == 1}
    several = {k: v for k, v in found.items() if len(v) > 1}
    pairs = F.map_from_arrays(F.array(*map(F.lit, several)), F.array(*map(F.lit, several.values())))
    letters = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c))
    # Only what is not ASCII is looked through for them.
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    some = F.rlike(beyond, F.lit("[" + "".join(several) + "]"))
    spread = F.when(some, F.array_join(letters, "")).otherwise(text)
    plain = F.regexp_replace(F.translate(spread, "".join(single), "".join(single.values())), r"[^\x00-\x7F]", "")
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), plain).otherwise(text)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(to_ascii(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def community_url(city: Column, name: Column) -> Column:
    return F.concat(F.lit("/"), slug(city), F.lit("/"), slug(name))


def strip_article(name: Column) -> Column:
    return F.regexp_replace(strip(F.lower(name)), f"^({'|'.join(ARTICLES)}) ", "")


def authority(url: Column) -> Column:
    """Host with port and user, empty where the URL can't be read."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def blocked(url: Column, domains: list[str], suffix: bool = False) -> Column:
    """Whether a listed domain occurs in the URL's host; with `suffix`, whether the host belongs to one."""
    host = F.lower(authority(url))
    listed = F.array(*[F.lit(d) for d in domains]).cast("array<string>")
    if suffix:
        return F.exists(listed, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    return F.exists(listed, lambda d: F.contains(host, d))


def ensure_scheme(url: Column) -> Column:
    """Trimmed, with https:// where no scheme is, null where blank."""
    bare = F.nullif(strip(url), F.lit(""))
    return F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def valid_links(links: Column) -> Column:
    return F.filter(links, lambda x: strip(x).rlike("^https?://"))


def email_or_null(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), email)


def email_key(email: Column) -> Column:
    return F.lower(strip(email))


def clean_tags(tags: Column, most: int = 8) -> Column:
    """Trimmed, without blanks, each once in order of appearance, the first `most`."""
    kept = F.filter(F.transform(tags, strip), lambda t: t != "")
    return F.slice(F.array_distinct(kept), 1, most)


def prepend_if_absent(items: Column, item: Column) -> Column:
    return F.when(F.array_contains(items, item), items).otherwise(F.array_prepend(items, item))


def merged_distinct(new: Column, old: Column) -> Column:
    """New items first, then the old ones that are not among them."""
    return F.array_distinct(F.concat(new, old))


def duration(seconds: Column) -> Column:
    """12.3s below a minute, 2m 5s from there, empty for null."""
    minutes = F.concat(
        F.floor(seconds / 60).cast("int").cast("string"), F.lit("m "), (seconds % 60).cast("int").cast("string"), F.lit("s")
    )
    text = F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s"))).otherwise(minutes)
    return F.coalesce(text, F.lit(""))


def clipped(text: Column, size: int) -> Column:
    """The first `size` characters, with an ellipsis where more follow."""
    return F.when(F.length(text) > size, F.concat(F.substr(text, F.lit(1), F.lit(size)), F.lit("…"))).otherwise(text)


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def title_case(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^https?://", "")


def model_provider(model: Column) -> Column:
    return F.when(F.contains(model, F.lit(":")), F.lit("local")).otherwise(F.lit("hosted"))


def model_short(model: Column) -> Column:
    return F.regexp_replace(model, ":.*$", "")


def is_free(fee: Column) -> Column:
    return F.coalesce(F.lower(fee).isin(FREE_WORDS), F.lit(False))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").when(confidence.isNotNull(), "low")


def percent(confidence: Column) -> Column:
    return F.format_string("%.0f%%", confidence * 100)


def map_radius(count: Column) -> Column:
    return F.greatest(F.lit(7.0), F.least(F.lit(22.0), 5 + F.sqrt(count) * 1.6))


def accepted_language(header: Column, known: list[str], default: str = "en", chosen: Column | None = None) -> Column:
    """The language chosen before (a cookie) where it is known, else the first known one of an Accept-Language header, in the order given."""
    codes = F.transform(F.split(header, ","), lambda x: F.lower(F.substring_index(F.substring_index(F.trim(x), ";", 1), "-", 1)))
    listed = F.array(*map(F.lit, known))
    first = F.get(F.filter(codes, lambda c: F.array_contains(listed, c)), F.lit(0))
    before = F.lit(None) if chosen is None else F.when(chosen.isin(known), chosen)
    return F.coalesce(before, first, F.lit(default))


def text_direction(language: Column) -> Column:
    return F.when(language.isin(RTL), "rtl").otherwise("ltr")


def api_language(locale: Column) -> Column:
    """The language tag that a self-hosted search takes for a locale."""
    return F.coalesce(F.try_element_at(_literal_map(SEARCH_LANGUAGE), locale), F.lit("en-US"))


def api_country(locale: Column) -> Column:
    """The country code that a keyed search takes for a locale."""
    return F.coalesce(F.try_element_at(_literal_map(SEARCH_COUNTRY), locale), F.lit("US"))


def schema_type(topic: Column) -> Column:
    """The schema.org type of a topic's groups."""
    return F.coalesce(F.try_element_at(_literal_map(TOPIC_TYPE), topic), F.lit("Organization"))


def _literal_map(values: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))


def minute(time: Column) -> Column:
    """A timestamp as it is shown: to the minute, with a space."""
    return F.date_format(time, "yyyy-MM-dd HH:mm")


def clock(time: Column) -> Column:
    return F.date_format(time, "HH:mm:ss")


def parse_iso(text: Column) -> Column:
    """An ISO time, with T or a space and with or without a zone; null where it can't be read."""
    return F.try_to_timestamp(text)


def rounded(seconds: Column) -> Column:
    """Two decimals; halves go to the even digit."""
    return F.bround(seconds, 2)


def short_token() -> Column:
    """Eight random hexadecimal digits, for items of a queue."""
    return F.substr(F.uuid(), F.lit(1), F.lit(8))


def shown_website(website: Column, links: Column) -> Column:
    """The website where it is a link, else the first social link that is one."""
    first = F.get(F.filter(links, is_link), F.lit(0))
    return F.coalesce(F.when(is_link(website), website), first)


def is_link(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit("http")), F.lit(False))


def first_links(links: Column, most: int = 2) -> Column:
    """The first few social links that are links."""
    return F.slice(F.filter(links, is_link), 1, most)


def shown_contact(contact: Column, email: Column, phone: Column) -> Column:
    """The free contact only where neither e-mail nor phone is known."""
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    return F.when(blank(email) & blank(phone), F.nullif(contact, F.lit("")))


def shown_sources(sources: Column, source: Column) -> Column:
    """The list of sources, or the one source where the list is empty."""
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, sources).otherwise(F.array(source))


def safe_redirect(target: Column) -> Column:
    return F.when(F.startswith(target, F.lit("/")), target).otherwise(F.lit("/"))


def interpolated(template: str, values: dict[str, Column]) -> Column:
    """{name} filled in, in one pass, so that a value's own braces stay; names without a value stay as they are."""
    pieces = re.split(r"\{(\w+)\}", template)
    shown = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            shown.append(F.lit(piece))
        else:
            shown.append(F.coalesce(values[piece].cast("string"), F.lit("")) if piece in values else F.lit("{" + piece + "}"))
    return F.concat(*shown)


def log_text(event: Column, fields: Column) -> Column:
    """event  k=v  k=v from a map of fields."""
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat_ws("=", e.key, e.value))
    return F.concat_ws("  ", event, F.array_join(pairs, "  "))


def richness(filled: list[Column], links: Column) -> Column:
    """How many of the fields hold something, and how many links there are."""
    full = sum((F.coalesce(c != "", F.lit(False)).cast("int") for c in filled), F.lit(0))
    return full + F.coalesce(F.size(links), F.lit(0))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def decode_entities(text: Column) -> Column:
    """Common named entities and numbered ones as the characters that they stand for."""

    def numbered(part: Column) -> Column:
        decimal, hexa = F.regexp_extract(part, r"^(\d{1,7});", 1), F.regexp_extract(part, r"^[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(decimal != "", decimal.cast("int")).when(hexa != "", F.conv(hexa, 16, 10).cast("int"))
        code = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), code)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.concat(char, F.regexp_replace(part, "^[^;]*;", "")), F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    rest = F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), numbered), "")
    out = F.when(F.contains(text, F.lit("&#")), F.concat(F.get(parts, F.lit(0)), rest)).otherwise(text)
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


#: Elements whose text is never shown, and those around the main text.
HIDDEN, AROUND = ["script", "style", "noscript", "template"], ["nav", "header", "footer", "aside", "form"]


def html_text(html: Column, without: list[str] = HIDDEN + AROUND) -> Column:
    """The text of a page without comments, tags and the elements named, in one pass over it; one that is never closed reaches to the end."""
    hidden = rf"<!--.*?(?:-->|\z)|<({'|'.join(without)})(?:\s[^>]*)?>.*?(?:</\1\s*>|\z)|<[^>]*>|[ \t\n\r\f\x{{A0}}]"
    text = decode_entities(F.regexp_replace(html, rf"(?is)(?:{hidden})+", " "))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x{A0}]+", " "))


#: Elements that begin and end a block of text.
BLOCKS = [
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3",
    "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "th", "thead", "tr", "ul",
]
#: What a block of text costs, so that short ones between others count against a run, and how often a character of a link counts against its block.
COST, LINKED = 25, 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _best_run(scores: Column) -> Column:
    """From and to (inclusive) of the run of scores with the largest sum, the first of equal ones; to is -1 where no score is above 0."""
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    start = F.struct(zero.alias("at"), zero.alias("sum"), zero.alias("first"), zero.alias("best"), zero.alias("from"), none.alias("to"))

    def step(x: Column, score: Column) -> Column:
        anew = x["sum"] <= 0
        total = F.when(anew, score).otherwise(x["sum"] + score)
        first = F.when(anew, x["at"]).otherwise(x["first"])
        better = total > x["best"]
        kept = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct((x["at"] + 1).alias("at"), total.alias("sum"), first.alias("first"), kept(total, x["best"]).alias("best"), kept(first, x["from"]).alias("from"), kept(x["at"], x["to"]).alias("to"))

    return F.aggregate(scores, start, step)


def dense_text(html: Column) -> Column:
    """The text of the densest run of blocks of a page: each counts its characters, less COST and less LINKED times its links' characters.

    Comments, hidden elements and those around the main text are left out first; a page without such a run gives
    an empty text. The page is read twice, whatever its blocks: once for what is left out, once for the blocks.
    """
    left_out = "|".join([*HIDDEN, *AROUND, "head"])
    body = F.regexp_replace(html, rf"(?is)<!--.*?(?:-->|\z)|<({left_out})(?:\s[^>]*)?>.*?(?:</\1\s*>|\z)", " ")
    pieces = F.split(F.regexp_replace(body, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:\s[^>]*)?/?>", "\x01"), "\x01")
    bare = lambda x: F.trim(F.regexp_replace(x, r"(?:<[^>]*>|[ \t\n\r\f\x{A0}])+", " "))
    linked = lambda x: F.length(bare(F.array_join(F.regexp_extract_all(x, F.lit(r"(?is)<a(?:\s[^>]*)?>(.*?)(?:</a\s*>|\z)"), F.lit(1)), " ")))
    links = lambda x: F.when(F.rlike(x, F.lit(r"(?i)<a[\s>]")), linked(x)).otherwise(0)
    blocks = F.filter(F.transform(pieces, lambda x: F.struct(bare(x).alias("text"), links(x).alias("links"))), lambda b: b["text"] != "")

    def best(known: Column) -> Column:
        scores = F.transform(known, lambda b: (F.length(b["text"]) - LINKED * b["links"] - COST).cast("long"))
        run = lambda r: F.slice(known, (r["from"] + 1).cast("int"), (r["to"] - r["from"] + 1).cast("int"))
        return F.array_join(F.transform(_let(_best_run(scores), run), lambda b: b["text"]), " ")

    return F.trim(decode_entities(_let(blocks, best)))


def main_text(html: Column, least: int = 100) -> Column:
    """The text of the page's article where it has `least` characters, else the densest run of its blocks, else
    all its text; null where none of them is so long."""
    article = F.regexp_extract(html, r"(?is)<(article|main)(?:\s[^>]*)?>(.*?)(?:</\1\s*>|\z)", 2)
    tries = [html_text(article), dense_text(html), html_text(html, HIDDEN)]
    # Each try is made only where the ones before fail, and once.
    return F.coalesce(*[F.get(F.filter(F.array(text), lambda t: F.length(t) >= least), F.lit(0)) for text in tries])
