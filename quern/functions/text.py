"""Text rules: normalising, parsing, classifying. Regular expressions avoid lookaround, so SQL engines agree on them."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.phrases import PhraseDictionary, found_labels

#: Moods and the words that show them, first match wins.
MOODS = (
    ("happy", "happy|joy|upbeat|dance|party|celebrate"),
    ("sad", "sad|depressed|cry|lonely|heartbreak"),
    ("angry", "angry|mad|rage|furious|hate"),
    ("romantic", "love|romantic|kiss|heart|valentine"),
    ("chill", "chill|relax|calm|peaceful|mellow"),
    ("energetic", "energy|pump|workout|intense|power"),
)
#: Tags of explicit songs.
EXPLICIT_TAGS = ("explicit", "profanity", "adult")
#: Fixed values of the placeholder rules.
PLACEHOLDER_TITLES = ("Found Song", "Found Track", "True Song", "True Track", "Lost Song", "Lost Track")
PLACEHOLDER_ADJECTIVES = "Blue|Red|Golden|Silver|Dark|Bright|Sweet|Wild|Free|Lost|Found|True|Faded|Shining|Burning|Rising"
PLACEHOLDER_TYPES = "Song|Track|Anthem|Hit|Tune|Number|Single|Piece|Jam|Record|Ballad|Beat"
PLACEHOLDER_PREFIXES = "Test|Demo|My|Sample|Fake|Example|Placeholder"
#: Words by severity, and phrases that are moderate wherever they stand.
SEVERITIES = ("clean", "mild", "moderate", "explicit")
EXPLICIT_WORDS = ("fuck", "fucking", "fucked", "motherfucker", "cunt", "nigga", "nigger")
MODERATE_WORDS = ("shit", "bitch", "bastard", "piss")
MILD_WORDS = ("damn", "hell", "crap", "ass", "cock", "dick", "pussy", "whore", "slut")
MODERATE_PHRASES = {
    "sexual": ("sex", "sexy", "horny", "naked", "strip", "porn", "orgasm", "masturbate", "erotic", "climax", "penetrate", "thrust", "blow job", "oral sex", "threesome", "bondage", "kinky"),
    "drugs": ("cocaine", "heroin", "meth", "crack", "weed", "marijuana", "cannabis", "molly", "ecstasy", "acid", "lsd", "shrooms", "xanax", "adderall", "oxy", "opioid", "fentanyl"),
    "violence": ("kill", "murder", "suicide", "rape", "abuse", "torture", "genocide", "terrorist", "bomb", "gun", "weapon", "violence"),
}
#: Phrases that make a title clearer, or less clear.
IDIOMS = (
    "break my heart", "falling in love", "love me tender", "crazy in love", "head over heels", "match made in heaven", "better half", "soulmate",
    "live your life", "follow your dreams", "time heals", "new beginning", "turn the page", "start over", "moving on", "let it go", "hold on",
    "party all night", "dance floor", "good times", "celebrate tonight", "turn up", "let loose", "have a ball", "living it up",
    "feeling blue", "on cloud nine", "walking on air", "down in the dumps", "over the moon", "through the roof", "hit rock bottom", "on top of the world",
    "summertime", "winter wonderland", "spring fever", "autumn leaves", "monday morning", "friday night", "weekend warrior", "late night",
    "turn it up", "pump up the volume", "drop the beat", "feel the rhythm", "sing along", "dance all night", "music to my ears", "sound of music",
)
METAPHORS = (
    "shadows of tomorrow", "echoes of yesterday", "whispers in the wind", "fragments of time", "rivers of memory", "valleys of sorrow",
    "crimson sky", "silver moonlight", "golden dawn", "velvet night", "crystal tears", "paper hearts", "plastic dreams", "neon lights",
    "meaning of life", "purpose of existence", "soul searching", "inner peace", "spiritual journey", "cosmic connection", "universal truth", "eternal love",
    "nowhere land", "wonderland", "paradise lost", "seventh heaven", "twilight zone", "no mans land", "promised land", "never never land",
)
#: Clean versions of words in titles; the last entry found in a title decides.
RADIO_EDITS = (
    ("fuck", "f***"), ("fucking", "f***ing"), ("motherfucker", "mother***er"), ("shit", "s***"), ("bitch", "b****"), ("nigga", "n***a"), ("ass", "a**"),
    ("what the fuck", "what the heck"), ("holy shit", "holy crap"), ("son of a bitch", "son of a gun"), ("damn it", "darn it"), ("piss off", "buzz off"),
)
CONFIDENCE_TAG = r"(?i)\[confidence:\s*(low|medium|high)\]\s*$"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
UUID4 = UUID.replace("[1-5]", "4")


def any_of(text: Column, phrases) -> Column:
    """Whether any phrase stands in the text, in this case. For many phrases take a ``PhraseDictionary``."""
    return functools.reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in phrases))


def clean_text(text: Column) -> Column:
    """Lower case; all but ASCII word characters to spaces; white space to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-zA-Z0-9_\s]", " "), r"\s+", " "))


def normalize_name(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def normalize_text(text: Column) -> Column:
    """Trimmed, inner white space single, one quotation mark off either edge."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), "^[\"']|[\"']$", "")


def normalize_isrc(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, r"[-\s]", ""))


def leading_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^([0-9]{4})", 1), F.lit("")).cast("int")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decade_label(year: Column) -> Column:
    return F.when(year.isNull(), "Unknown").otherwise(F.concat(decade(year).cast("string"), F.lit("s")))


def mood(text: Column) -> Column:
    found = None
    for name, words in MOODS:
        test = any_of(F.lower(text), words.split("|"))
        found = F.when(test, name) if found is None else found.when(test, name)
    return found.otherwise("neutral")


def is_explicit(tags: Column) -> Column:
    return F.exists(tags, lambda t: F.lower(t).isin(*EXPLICIT_TAGS))


def placeholder_reason(title: Column, artist: Column, phrases: Column, source: Column, mbid: Column) -> Column:
    """The catalog tool's five rules, the first that holds; null for a real title. Verified records escape the loose ones."""
    title = F.trim(title)
    verified = F.coalesce((source == "musicbrainz") & (mbid != ""), F.lit(False))
    words = F.split(title, r"\s+")
    two = (F.size(words) == 2) & F.get(words, F.lit(1)).isin(*PLACEHOLDER_TYPES.split("|"))
    expected = F.concat(F.filter(F.split(F.lower(title), r"\s+"), lambda w: w != ""), F.split(F.lower(artist), r"\s+"))
    given = F.filter(F.transform(F.split(F.lower(phrases), ","), lambda p: F.trim(p)), lambda p: p != "")
    trivial = (phrases != "") & (F.size(F.array_except(given, expected)) == 0) & (F.size(given) == F.size(expected)) & (F.size(given) <= 4)
    return (
        F.when(title.isin(*PLACEHOLDER_TITLES), "Exact match")
        .when(title.rlike(rf"(?i)^({PLACEHOLDER_ADJECTIVES})\s+({PLACEHOLDER_TYPES})(\s+[0-9]+)?$"), "Adjective+Type pattern")
        .when(~verified & two, "Simple type suffix")
        .when(title.rlike(rf"(?i)^({PLACEHOLDER_PREFIXES})\s+({PLACEHOLDER_TYPES})\s+[0-9]+$"), "Numbered placeholder")
        .when(~verified & title.rlike(rf"(?i)^({PLACEHOLDER_TYPES})\s+[0-9]+$"), "Numbered placeholder")
        .when(F.coalesce(trivial, F.lit(False)), "Trivial phrases")
    )


def is_placeholder_stored(title: Column) -> Column:
    """The looser rules of the stored flag: any word before Song or Track, any word, type and number."""
    return (
        title.isin(*PLACEHOLDER_TITLES)
        | title.rlike(rf"(?i)^({PLACEHOLDER_ADJECTIVES})\s+({PLACEHOLDER_TYPES})(\s+[0-9]+)?$")
        | title.rlike(r"(?i)^[a-zA-Z0-9_]+\s+(Song|Track)$")
        | title.rlike(rf"(?i)^[A-Za-z]+\s+({PLACEHOLDER_TYPES})\s+[0-9]+$")
    )


#: Ranks of severity by what stands in a text: words alone, phrases anywhere.
_SEVERE = [(w, rank, "token") for rank, words in ((3, EXPLICIT_WORDS), (2, MODERATE_WORDS), (1, MILD_WORDS)) for w in words]
_SEVERE += [(p, 2, "anywhere") for group in MODERATE_PHRASES.values() for p in group]


def severity_rank(text: Column) -> Column:
    """0 clean, 1 mild, 2 moderate, 3 explicit: words alone, phrases anywhere, all found in one walk over the text."""
    return F.coalesce(F.array_max(found_labels(F.lower(text), PhraseDictionary(_SEVERE))), F.lit(0))


def severity(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def blocked_in_room(rank: Column, allow_explicit: Column, strict: bool = True) -> Column:
    return F.when(allow_explicit, F.lit(strict) & (rank == 3)).otherwise(rank >= 2)


def is_obscure(title: Column) -> Column:
    """Over 100 characters, over three special characters, or a word over 15."""
    special = F.length(title) - F.length(F.regexp_replace(title, r"[()\[\]{}<>|@#$%^&*+=]", ""))
    return (F.length(title) > 100) | (special > 3) | F.exists(F.split(title, r"\s+"), lambda w: F.length(w) > 15)


def clarity_bonus(message: Column, title: Column) -> Column:
    """0.2 if one holds the other or an idiom stands in either; -0.2 for metaphors or obscure titles."""
    m, t = F.lower(F.trim(message)), F.lower(F.trim(title))
    clear = F.contains(m, t) | F.contains(t, m) | any_of(t, IDIOMS) | any_of(m, IDIOMS)
    return F.when(clear, 0.2).when(any_of(t, METAPHORS) | is_obscure(t), -0.2).otherwise(0.0)


def radio_edit(title: Column) -> Column:
    """The title with its explicit words replaced; null if it has none."""
    edit = F.lit(None).cast("string")
    for word, clean in RADIO_EDITS:
        edit = F.when(F.contains(F.lower(title), F.lit(word)), F.regexp_replace(title, f"(?i){word}", clean)).otherwise(edit)
    return edit


def matches_keyword(text: Column, keywords) -> Column:
    """Whole words, any case; keywords are taken literally."""
    import re

    return text.rlike(r"(?i)\b(" + "|".join(map(re.escape, keywords)) + r")\b")


def confidence_tag(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, CONFIDENCE_TAG, 1)), F.lit(""))


def without_confidence_tag(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)\s*\[confidence:\s*(low|medium|high)\]\s*$", ""))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def output_problem(text: Column, most: int) -> Column:
    """What is wrong with generated text; null if nothing is."""
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty response")
        .when(F.length(text) > most, F.concat(F.lit("too long: "), F.length(text).cast("string"), F.lit(" chars")))
        .when(confidence_tag(text).isNull(), "missing or malformed confidence tag")
        .when(F.trim(text).rlike("(?i)^confidence:"), "starts with a confidence label")
    )


def length_bucket(n: Column) -> Column:
    return F.when(n < 20, "<20").when(n < 50, "20-49").when(n <= 90, "50-90").when(n <= 100, "91-100").otherwise(">100")


def list_of(text: Column) -> Column:
    """A comma list as an array: trimmed, without empty parts."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def int_or(text: Column, default: int) -> Column:
    """The leading integer of a text; the default if there is none or it is 0."""
    n = F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).cast("int")
    return F.coalesce(F.nullif(n, F.lit(0)), F.lit(default))


def embedding_text(*parts: Column) -> Column:
    return F.concat_ws(" — ", *parts)


def credit(names: Column) -> Column:
    return F.array_join(names, " / ")


def hashed_ip(ip: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(ip, F.lit(salt)), 256), 1, 32)


def masked(text: Column, shown: int = 8) -> Column:
    return F.concat(F.substring(text, 1, shown), F.lit("..."))


def rolling_hash36(text: Column) -> Column:
    """32-bit rolling hash (times 31, plus each code) in base 36, as short labels for addresses.

    Sums are kept modulo 2^32 and read as signed, then made absolute."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    raw = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c) % F.lit(4294967296).cast("bigint"))
    signed = F.when(raw >= 2147483648, raw - 4294967296).otherwise(raw)
    return F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))


def avatar_bucket(text: Column, buckets: int) -> Column:
    """A number below ``buckets`` by FNV-1a over the codes of ``text``.

    Each step multiplies by the prime as shifts of signed 32-bit numbers, whose
    sum is only cut to 32 bits by the next step's xor; so the last sum is not.
    """
    int32 = lambda x: F.pmod(x + 2147483648, F.lit(4294967296).cast("bigint")) - 2147483648

    def step(h: Column, code: Column) -> Column:
        x = int32(h).bitwiseXOR(code)
        return x + sum((int32(x * (1 << k)) for k in (1, 4, 7, 8, 24)), F.lit(0))

    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.abs(F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)) % buckets


def is_handle(text: Column) -> Column:
    return text.rlike("^[a-z]+-[a-z]+$")


def _md5_number(text: Column) -> Column:
    """The first 32 bits of the MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def handle(seed: Column, first: list[str], second: list[str]) -> Column:
    """A word of each list joined by a hyphen, by two hashes of the seed: the same seed gives the same handle."""
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (_md5_number(F.concat(seed.cast("string"), F.lit(salt))) % len(words) + 1).cast("int"))
    return F.concat(pick(first, "a"), F.lit("-"), pick(second, "n"))


def size_status(mb: Column, yellow: float, red: float) -> Column:
    return F.when(mb >= red, "RED").when(mb >= yellow, "YELLOW").otherwise("GREEN")
