"""PII: keyed, type-consistent surrogates for detected entities, by SQL functions alone.

Detection is one regular expression; what it finds is a *mention*. A mention holds one
entity (kind and normal form), or for persons one per name that is not on the list of given
names. The surrogate of an entity is drawn from a keyed hash of its kind, normal form and
attempt, in the same format: mail addresses keep their shape and get a reserved domain;
numbers keep their digits' count and the mention's punctuation; card numbers and IBANs keep
valid check digits (a number without one is no card and stays); hexadecimal secrets and IPv6 addresses stay hexadecimal, private IP
addresses private; letters stay in their script (``SCRIPTS``) and case. Listed given names
change to another of the same gender and script by a keyed cycle of the list; others, whose
gender the title tells, to invented ones with an ending of that gender. Surnames are
invented; Russian ones share a stem between the genders and keep each one's ending. Titles
stay. Persons are found by a title or a listed given name (a parameter): SQL functions have
no other way to tell a name from a word, so a name with neither is not found.

Equal entities get equal surrogates wherever they stand (coreference), composed and
decomposed accents being equal. The first surname of a person's mention is sought again, as
a word of its own, in the rest of that document (spelt as there). Distinct entities get
distinct surrogates: over the table of distinct entities, a surrogate that two of them share,
or that is itself an entity of the corpus, is drawn again with the next attempt (longer from
the fourth on, where the kind allows) for all but the first, until none is left. A draw of a
fixed format can only go on failing where the format's values run short, so formats with more
than a quarter of their values in use are not drawn: a keyed permutation of *all* values of the
format (each character moved within its class by a hash of those before it, the first one
never by nothing) keeps them distinct and none its own. Only in such formats can a
surrogate be a value that stands elsewhere in the corpus.

Only documents with redrawn entities are joined with them, by their text's hash (so rows
without an id, and copies, are many keys or one small map); that table is broadcast if it has at
most ``BROADCAST_CHARS`` characters and otherwise joined by a shuffle.

The key is the argument or the session's ``spark.ledgerloom.pii.key``; a fixed one serves
where neither is set, as in tests, and is no secret.

Edge cases: a secret without any letter or digit is none and stays; a null text stays null; a text without mentions is returned as it is; rows may
repeat, have null ids, or share ids; mentions do not overlap and are found from the left;
other columns pass through (``text`` is replaced; ``n_entities`` and ``entity_kinds`` are
added in place of any of these names; ``_redrawn``, ``_mentions``, ``_surnames``, ``_pieces``,
``_again`` and ``_redrawn_in`` are dropped). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import inputs
from ledgerloom.plans.scratch import written

KEY, KEY_CONF = "ledgerloom", "spark.ledgerloom.pii.key"
BROADCAST_CHARS = 4_000_000
LENGTHEN_FROM = 4
#: A format is permuted, not drawn, from one entity per so many of its values.
CROWDED = 4

GIVEN_NAMES = {
    ("Latin", "female"): "Aisha Alice Amelie Ananya Barbara Carmen Caroline Catherine Charlotte Chiara Claire Elizabeth Emily Emma Fatima Francesca Greta Hannah Ingrid Isabella Jennifer Jessica Johanna Julia Katharina Laura Leila Linda Lucia Margaret Maria Marie Mary Mei Olivia Patricia Priya Sarah Sofia Susan Yuki Zainab".split(),
    ("Latin", "male"): "Ahmed Alexander Andrew Antonio Arjun Benjamin Carlos Charles Daniel David Edward Felix François George Giovanni Hans Henry Hiroshi Ibrahim James Jan Jean John Joseph José Juan Kenji Klaus Luca Lukas Michael Miguel Mohammed Omar Paul Peter Pierre Raj Ravi Robert Stefan Sven Thomas Wei William".split(),
    ("Cyrillic", "female"): "Анастасия Анна Виктория Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("Cyrillic", "male"): "Александр Алексей Андрей Виктор Владимир Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    ("Greek", "female"): "Αικατερίνη Βασιλική Ελένη Μαρία Σοφία".split(),
    ("Greek", "male"): "Γεώργιος Δημήτρης Ιωάννης Κώστας Νίκος".split(),
}
#: Titles and the gender that they tell.
TITLES = {
    "male": "Mr Herr Señor Monsieur Господин Κύριος".split(), "female": "Mrs Ms Miss Frau Señora Señorita Madame Mademoiselle Госпожа Κυρία".split(), "": "Dr Prof".split(),
}
LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Blocks of Unicode (first, last), and the lower-case letters to draw from for letters in them (first, how many).
SCRIPTS = {
    "Greek": (0x370, 0x3FF, 0x3B1, 17), "Cyrillic": (0x400, 0x52F, 0x430, 32), "Armenian": (0x530, 0x58F, 0x561, 38), "Hebrew": (0x590, 0x5FF, 0x5D0, 27),
    "Arabic": (0x600, 0x6FF, 0x628, 19), "Devanagari": (0x900, 0x97F, 0x915, 36), "Thai": (0xE00, 0xE7F, 0xE01, 46), "Georgian": (0x10A0, 0x10FF, 0x10D0, 33),
    "Hiragana": (0x3040, 0x309F, 0x3042, 80), "Katakana": (0x30A0, 0x30FF, 0x30A2, 80), "Han": (0x4E00, 0x9FFF, 0x4E00, 20_000), "Hangul": (0xAC00, 0xD7AF, 0xAC00, 11_172),
}
#: Onsets and vowels of invented names, and their endings for a woman and a man, by script.
SYLLABLES = {
    "Latin": ("bdfgklmnprstvz", "aeiou", "a", "o"), "Greek": ("βγδζκλμνπρστφ", "αεηιο", "α", "ος"), "Cyrillic": ("бвгдзклмнпрстф", "аеиоу", "а", ""),
}
SECRET_NAME = r"""(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}["']?"""
_NAME = r"\p{Lu}(?:['’]\p{Lu})?[\p{Ll}\p{M}]++(?:[-'’]?\p{Lu}[\p{Ll}\p{M}]++)?"
_IPV6 = r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
_IPV4 = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"


def _by_first_letter(names: list[str]) -> str:
    """Alternatives that share their first letter are tried only where it stands."""
    first = sorted({n[0] for n in names})
    return "(?:" + "|".join(f"{c}(?:{'|'.join(n[1:] for n in names if n[0] == c)})" for c in first) + ")"


def _spellings(name: str) -> list[str]:
    """A name with composed and with decomposed accents."""
    return sorted({unicodedata.normalize(form, name) for form in ("NFC", "NFD")})


def given_names() -> list[str]:
    return [x for names in GIVEN_NAMES.values() for n in names for x in _spellings(n)]


def titles(gender: str | None = None) -> list[str]:
    return [x for g, names in TITLES.items() if gender in (None, g) for n in names for x in _spellings(n)]


@cache
def person_pattern() -> str:
    """The regular expression for persons: a title and up to two names, or a given name and one or two."""
    given = _by_first_letter(given_names())
    return (
        r"(?=[A-ZÀ-ÞΆ-ΩЀ-Я])(?<![\p{L}\p{M}])"
        rf"(?:{_by_first_letter(titles())}\.? (?:{given}(?![\p{{L}}\p{{M}}]) )?{_NAME}(?: {_NAME})?|{given}(?: {_NAME}){{1,2}})"
    )


@cache
def mention_pattern() -> str:
    """The regular expression that finds every mention; a look at one character rules most places out."""
    numbers = "|".join((
        rf"(?<![\d.]){_IPV4}(?!\.?\d)",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        r"(?<![\d-])\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?![\d-])",
        r"(?<!\d)\d{13,19}(?!\d)",
        r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,8}){1,3}(?!\d)",
        r"\+\d{8,15}(?!\d)",
        r"(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
        r"(?<![\d.-])\d{3}([.-])\d{3}\2\d{4}(?![\d.-])",
    ))
    return "|".join((
        rf"(?=[pPsStTaA])(?<![\p{{L}}\p{{N}}]){SECRET_NAME}[A-Za-z0-9+/_\-]{{8,}}",
        r"(?=A)(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
        r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]++)++",
        rf"(?=[0-9A-Fa-f]{{1,4}}:){_IPV6}",
        rf"(?=[0-9(+])(?:{numbers})",
        r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        person_pattern(),
    ))


def _searched(text: Column, search: Callable[[str], Column]) -> Column:
    """``search(pattern)``; only persons are sought in a text without the characters that all other mentions hold."""
    others = text.contains("@") | text.contains("=") | text.contains(":") | text.rlike("[0-9]")
    others = others | text.contains("AKIA") | text.contains("ASIA")  # access keys need no digit
    return F.when(others, search(mention_pattern())).otherwise(search(person_pattern()))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, also within another lambda."""
    return F.transform(F.array(value), then)[0]


#: The kind of what is no entity and stays: a number as long as a card's with a wrong check digit, a secret of signs alone.
PLAIN = "plain"


def kind_of(m: Column) -> Column:
    return (
        F.when(m.rlike(f"^{SECRET_NAME}"), F.when(m.rlike(f"^{SECRET_NAME}.*[A-Za-z0-9]"), "secret").otherwise(PLAIN))
        .when(m.contains("@"), "email")
        .when(m.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$"), "access_key")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(m.rlike(r"^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$"), "ipv6")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^\d{13}|^\d{4}[ -]\d{4}[ -]\d{4}"), F.when(_luhn_sum(F.regexp_replace(m, r"\D", ""), 1) % 10 == 0, "card").otherwise(PLAIN))
        .when(m.rlike(r"^[+(\d]"), "phone")
        .otherwise("person")
    )


def normal_form(kind: Column, m: Column) -> Column:
    """What equal entities have in common, for all kinds but persons."""
    digits = F.regexp_replace(m, r"\D", "")
    return (
        F.when(kind == "secret", F.regexp_replace(m, f"^{SECRET_NAME}", ""))
        .when(kind == "email", composed(F.lower(m)))
        .when(kind == "ipv6", F.lower(m))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "phone", F.concat(F.when(m.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(m)
    )


@cache
def _compositions() -> dict[str, str]:
    """Letters with a mark as two characters and as one: the letters of these scripts that Unicode composes."""
    every = (chr(i) for i in [*range(0xC0, 0x180), *range(0x386, 0x3CF), *range(0x400, 0x460)])
    return {d: c for c in every if len(d := unicodedata.normalize("NFD", c)) == 2}


def composed(text: Column) -> Column:
    """``text`` with letters and marks composed; only texts with marks are looked at."""
    pairs = [x for pair in _compositions().items() for x in pair]
    table = F.expr(f"map({_literals(pairs)})")
    letters = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}*"), F.lit(0)), lambda g: F.coalesce(F.try_element_at(table, g), g))
    return F.when(text.rlike(r"\p{M}"), F.array_join(letters, "")).otherwise(text)


def _given_cycle(key: str) -> dict[str, str]:
    """Each given name's surrogate: the next of its list in keyed order; every spelling of a name has the same."""
    out = {}
    for names in GIVEN_NAMES.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|given|{n}".encode()).hexdigest())
        out |= {x: new for n, new in zip(order, order[1:] + order[:1], strict=True) for x in _spellings(n)}
    return out


def _literals(values: list[str]) -> str:
    """Names as SQL literals; they hold no quotes."""
    return ", ".join(f"'{v}'" for v in values)


def _is(word: Column, values: list[str]) -> Column:
    return F.array_contains(F.expr(f"array({_literals(values)})"), word)


def _stem(surname: Column) -> Column:
    """What the forms of a Russian surname for a man and a woman share: the man's form. ``surname`` is in lower case."""
    ended = F.when(surname.rlike("(ов|ев|ёв|ин|ын)а$"), F.substring(surname, F.lit(1), F.length(surname) - 1)).when(
        surname.rlike("(ск|цк)ая$"), F.concat(F.substring(surname, F.lit(1), F.length(surname) - 2), F.lit("ий"))
    )
    return F.coalesce(ended, surname)


def person_words(m: Column) -> Column:
    """The words of a person's mention as (word, kind, norm): titles and listed given names have no kind, all others are an entity's.

    A name between a title and another name is a given name of the title's gender.
    """
    words = F.split(m, " ")
    bare = lambda w: F.regexp_replace(w, r"\.$", "")
    first = bare(words[0])
    gender = F.when(_is(first, titles("female")), "given_female").when(_is(first, titles("male")), "given_male")

    def word(w: Column, i: Column) -> Column:
        fixed = (i == 0) & _is(bare(w), titles()) | _is(w, given_names())
        kind = F.when(~fixed, F.when((i == 1) & (F.size(words) > 2) & gender.isNotNull(), gender).otherwise("surname"))
        return F.struct(w.alias("word"), kind.alias("kind"), F.when(~fixed, _stem(composed(F.lower(w)))).alias("norm"))

    return F.transform(words, word)


def mention_parts(m: Column) -> Column:
    """What a mention consists of, as (word, kind, norm): a person's words, of any other kind the mention itself."""
    whole = lambda kind: F.array(F.struct(m.alias("word"), F.nullif(kind, F.lit(PLAIN)).alias("kind"), normal_form(kind, m).alias("norm")))
    return let(kind_of(m), lambda kind: F.when(kind == "person", person_words(m)).otherwise(whole(kind)))


def entities_of(m: Column) -> Column:
    """The entities of a mention, as an array of (kind, norm)."""
    named = F.filter(mention_parts(m), lambda w: w["kind"].isNotNull())
    return F.transform(named, lambda w: F.struct(w["kind"].alias("kind"), w["norm"].alias("norm")))


def _number(hexes: Column, i: Column) -> Column:
    """The i-th (from 0) number below 65536 of a string of hexadecimal digits."""
    return F.conv(F.substring(hexes, i * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), number % len(letters) + 1, F.lit(1))


def _hexes(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """At least four hexadecimal digits for each character of the normal form, and 64 more."""
    seed = F.sha2(F.concat_ws("\u001f", F.lit(key), kind, norm, attempt.cast("string")), 256)
    blocks = F.sequence(F.lit(0), ((F.length(norm) + 47) / 32).cast("int"))
    return let(seed, lambda own: F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat(own, i.cast("string")), 512)), ""))


def _character(number: Column) -> Column:
    """The character of a number below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 4, "0")), "UTF-16BE")


def _same_shape(text: Column, hexes: Column, skip: Column | int, hexadecimal: Column) -> Column:
    """Each digit and letter from the ``skip``-th on changed for another of its script; the rest stays."""
    blocks = F.expr("array(" + ", ".join(f"named_struct('first', {a}, 'last', {b}, 'begin', {c}, 'count', {d})" for a, b, c, d in SCRIPTS.values()) + ")")

    def letter(c: Column, n: Column) -> Column:
        own = F.filter(blocks, lambda b: F.ascii(c).between(b["first"], b["last"]))
        drawn = let(F.get(own, F.lit(0)), lambda b: _character(F.coalesce(b["begin"] + n % b["count"], F.lit(97) + n % 26)))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(drawn)).otherwise(drawn)

    def change(c: Column, i: Column) -> Column:
        new = lambda n: (
            F.when((i < skip) | c.rlike(r"^[^\p{L}0-9]"), c).when(hexadecimal & c.rlike("[0-9a-f]"), _pick("0123456789abcdef", n)).when(c.rlike("[0-9]"), _pick("0123456789", n)).otherwise(letter(c, n))
        )
        return F.coalesce(let(_number(hexes, i), new), F.lit(""))

    return F.array_join(F.transform(F.split(text, ""), change), "")


def _luhn_sum(digits: Column, even: int) -> Column:
    """Sum with every second digit doubled, counted from the right; ``even``: which ones (0: the last is doubled)."""
    value = lambda d, i: F.when(i % 2 == even, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _luhn(drawn: Column) -> Column:
    """``drawn`` with its last digit made to fit."""
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    last = ((F.lit(10) - _luhn_sum(body, 0) % 10) % 10).cast("string")
    return F.concat(body, last)


def _iban(drawn: Column) -> Column:
    """``drawn`` with the check digits that make it valid."""
    turned = F.concat(F.substring(drawn, F.lit(5), F.length(drawn)), F.substring(drawn, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.rlike("^[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: ((a * F.when(c.rlike("^[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int"),
    )
    return F.concat(F.substring(drawn, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(drawn, F.lit(5), F.length(drawn)))


def _invented(kind: Column, norm: Column, hexes: Column, syllables: Column, shaped: Column) -> Column:
    """A lower-case name of so many syllables in the script of the original, with the ending of its gender if that is known; ``shaped`` for scripts without syllables."""
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), 1).when(norm.rlike(r"\p{IsGreek}"), 2).when(norm.rlike(r"\p{IsLatin}"), 0)
    table = [SYLLABLES[x] for x in ("Latin", "Cyrillic", "Greek")]
    of = lambda k, column: F.get(F.array(*(F.lit(t[column]) for t in table)), k)
    pick = lambda letters, n: F.substring(letters, n % F.length(letters) + 1, F.lit(1))

    def name(k: Column) -> Column:
        body = F.array_join(
            F.transform(F.sequence(F.lit(0), syllables - 1), lambda i: F.concat(pick(of(k, 0), _number(hexes, i * 2)), pick(of(k, 1), _number(hexes, i * 2 + 1)))), ""
        )
        ending = (
            F.when(kind == "given_female", of(k, 2)).when(kind == "given_male", of(k, 3)).when((k == 1) & norm.rlike("(ов|ев|ёв|ин|ын)$"), "ов").when((k == 2) & norm.rlike("ς$"), "ος")
        )
        last = F.when((k == 1) & norm.rlike("(ск|цк)ий$"), "ский").otherwise(F.concat(pick(of(k, 0), _number(hexes, syllables * 2)), ending))
        return F.concat(body, F.coalesce(last, F.lit("")))

    return F.coalesce(let(script, lambda k: F.when(k.isNotNull(), name(k))), shaped)


def _private(norm: Column) -> Column:
    """How many characters at its beginning make an IP address a private or local one."""
    four = F.length(F.regexp_extract(norm, r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.)", 1))
    six = F.length(F.regexp_extract(norm, r"^(f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)", 1))
    return F.greatest(four, six)


NAMES = ("surname", "given_female", "given_male")


def _fixed(kind: Column, norm: Column) -> Column:
    """How many characters at its beginning an entity keeps."""
    return (
        F.when(kind.isin("access_key", "iban"), 4).when(kind == "card", 1).when((kind == "phone") & norm.startswith("+"), 2)
        .when(kind.isin("ipv4", "ipv6"), _private(norm)).otherwise(0)
    )


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate's normal form."""
    extra = F.greatest(attempt - (LENGTHEN_FROM - 1), F.lit(0))
    hexadecimal = _hexadecimal(kind, norm)
    email = kind == "email"
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    label, top = F.substring_index(domain, ".", 1), F.substring_index(domain, ".", -1)

    def draw(h: Column) -> Column:
        # an address's label is drawn for its domain, so that domains are told apart and recognised
        digits = F.when(email, F.concat(F.substring(h, F.lit(1), (F.length(local) + 1) * 4), _hexes(key, F.lit("domain"), domain, F.lit(0)))).otherwise(h)
        text = F.when(email, F.concat(local, F.lit("@"), label)).otherwise(norm)
        # of a public address the first octet is one that has no private or local range
        public = let(_number(h, F.lit(0)) % 120 + 11, lambda n: F.when(n == 127, 131).otherwise(n))
        kept = F.size(F.split(F.substring(norm, F.lit(1), _private(norm)), r"\.")) - 1
        octet = lambda o, i: F.when(i < kept, o).when(i == 0, public.cast("string")).otherwise((_number(h, i) % 254 + 1).cast("string"))
        octets = F.array_join(F.transform(F.split(norm, r"\."), octet), ".")
        longer = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: _pick(LATIN, _number(h, i))), "")
        syllables = F.lit(2) + F.when(norm.rlike("(ов|ев|ёв|ин|ын|[сц]кий|ς)$") | kind.startswith("given"), 0).otherwise(1) + extra

        def finish(drawn: Column) -> Column:
            reserved = F.concat(F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise("org"))
            mail = F.concat(F.substring_index(drawn, "@", 1), F.when(extra > 0, longer).otherwise(""), F.lit("@"), F.substring_index(drawn, "@", -1), reserved)
            return (
                F.when(email, mail).when(kind == "iban", _iban(drawn)).when(kind == "card", _luhn(drawn)).when(kind == "ipv4", octets)
                .when(kind.isin(*NAMES), _invented(kind, norm, h, syllables, F.concat(drawn, F.when(extra > 0, longer).otherwise("")))).otherwise(drawn)
            )

        return let(_same_shape(text, digits, _fixed(kind, norm), hexadecimal), finish)

    return let(_hexes(key, kind, norm, attempt), draw)


def _fill(shape: Column, letters: Column, wanted: str) -> Column:
    """``shape`` with its characters that match ``wanted`` changed for those of ``letters`` in order."""
    step = lambda a, c: F.when(
        c.rlike(wanted), F.struct(F.concat(a["out"], F.substring(letters, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda a: a["out"])


def _cased(like: Column, text: Column) -> Column:
    """``text`` (lower case) in the manner of ``like``: all capitals, a capital first, or neither."""
    return (
        F.when(like.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*$") & (F.length(like) > 1), F.upper(text))
        .when(like.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))
        .otherwise(text)
    )


def render(key: str, m: Column, redrawn: Column) -> Column:
    """What a mention is replaced with; ``redrawn`` maps the kind and normal form of redrawn entities to their surrogate."""
    cycle = F.expr(f"map({_literals([x for pair in _given_cycle(key).items() for x in pair])})")

    def spelt(w: Column, new: Column) -> Column:
        """The surrogate ``new`` in the manner of the word it stands for."""
        kind, word = w["kind"], w["word"]
        woman = F.lower(word) != w["norm"]  # a Russian surname's form for a woman
        name = F.when(woman & new.rlike("ский$"), F.regexp_replace(new, "ий$", "ая")).when(woman & new.rlike("ов$"), F.concat(new, F.lit("а"))).otherwise(new)
        return (
            F.when(kind == "secret", F.concat(F.regexp_extract(word, f"^{SECRET_NAME}", 0), new))
            .when(kind.isin("ssn", "card", "phone"), _fill(word, F.regexp_replace(new, r"\D", ""), "^[0-9]"))
            .when(kind == "iban", _fill(word, new, "^[A-Z0-9]"))
            .when(kind.isin("email", "ipv6"), _cased(word, new))
            .when(kind.isin(*NAMES), _cased(word, name))
            .otherwise(new)
        )

    def part(w: Column) -> Column:
        drawn = F.coalesce(F.try_element_at(redrawn, F.concat_ws("\u001f", w["kind"], w["norm"])), surrogate(key, w["kind"], w["norm"], F.lit(0)))
        return F.when(w["kind"].isNull(), F.coalesce(F.try_element_at(cycle, w["word"]), w["word"])).otherwise(let(drawn, lambda new: spelt(w, new)))

    return F.array_join(F.transform(mention_parts(m), part), " ")


#: Characters that are drawn from, by the sign for their class in a format.
CLASSES = {"h": "0123456789abcdef", "9": "0123456789", "A": LATIN.upper(), "a": LATIN}


def _hexadecimal(kind: Column, norm: Column) -> Column:
    return (kind == "ipv6") | (kind == "secret") & norm.rlike("^[0-9a-f]+$")


def _kept(kind: Column, norm: Column) -> Column:
    """How many characters at its beginning a permuted entity keeps: as drawn ones, and a public IPv4 address its first two numbers."""
    return F.when((kind == "ipv4") & (_private(norm) == 0), F.length(F.regexp_extract(norm, r"^\d+\.\d+\.", 0))).otherwise(_fixed(kind, norm))


def _format(kind: Column, norm: Column) -> Column:
    """The format that an entity and its surrogates share, as (kept, classes); null where surrogates may be longer.

    ``kept`` is what its surrogates begin with, ``classes`` has a sign of ``CLASSES`` for every other
    character that may change: ``o`` for a number of an IPv4 address, a check digit as itself.
    """
    kept = _fixed(kind, norm)
    rest = F.substring(norm, kept + 1, F.length(norm))
    octets = F.array_join(F.array_repeat(F.lit("o"), F.size(F.split(rest, r"\."))), "")
    typed = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    classes = (
        F.when(kind == "ipv4", octets).when(kind == "card", F.concat(F.substring(typed, F.lit(1), F.length(typed) - 1), F.lit("#")))
        .when(_hexadecimal(kind, norm), F.regexp_replace(rest, "[0-9a-f]", "h")).otherwise(typed)
    )
    # check digits follow from the others
    begin = F.when(kind == "iban", F.substring(norm, 1, 2)).otherwise(F.substring(norm, F.lit(1), kept))
    return F.when(~kind.isin("email", *NAMES), F.struct(begin.alias("kept"), classes.alias("classes")))


def _bits(classes: Column) -> Column:
    """The binary logarithm of the number of a format's values."""
    sizes = {"o": 254} | {c: len(letters) for c, letters in CLASSES.items()}
    return sum((F.length(F.regexp_replace(classes, f"[^{c}]", "")) * math.log2(n) for c, n in sizes.items()), F.lit(0.0))


def permuted(key: str, kind: Column, norm: Column) -> Column:
    """The entity's partner in a keyed permutation of all values of its format; never itself."""
    seed = F.sha2(F.concat_ws("\u001f", F.lit(f"{key}|permuted"), kind), 256)
    table = F.expr(f"map({_literals([x for pair in CLASSES.items() for x in pair])})")
    last = F.length(norm) - (kind == "card").cast("int")

    def moved(before: Column, at: Column, first: Column, size: Column) -> Column:
        """``at`` (from 0) moved within ``size`` values by a hash of the original's characters before it."""
        n = _number(F.sha2(F.concat(seed, before), 256), F.lit(0))
        return (at + F.when(first, n % (size - 1) + 1).otherwise(n % size)) % size

    def octet(a: Column, o: Column) -> Column:
        value = moved(a["before"], o.cast("int"), a["first"], F.lit(256)).cast("string")
        return F.struct(F.concat(a["out"], F.when(a["first"], "").otherwise("."), value).alias("out"), F.concat(a["before"], o, F.lit(".")).alias("before"), F.lit(False).alias("first"))

    def letter(hexadecimal: Column) -> Callable[[Column, Column], Column]:
        def step(a: Column, c: Column) -> Column:
            own = F.when(hexadecimal & c.rlike("[0-9a-f]"), "h").when(c.rlike("[0-9]"), "9").when(c.rlike("[A-Z]"), "A").when(c.rlike("[a-z]"), "a")
            letters = F.try_element_at(table, own)
            new = F.substring(letters, moved(a["before"], F.instr(letters, c) - 1, a["first"], F.length(letters)) + 1, F.lit(1))
            return F.struct(F.concat(a["out"], F.coalesce(new, c)).alias("out"), F.concat(a["before"], c).alias("before"), (a["first"] & own.isNull()).alias("first"))

        return step

    def walk(parts: Column, begin: Column, step: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(F.lit("").alias("out"), begin.alias("before"), F.lit(True).alias("first"))
        return F.concat(begin, F.aggregate(parts, start, step, lambda a: a["out"]))

    kept = _kept(kind, norm)
    begin, rest = F.substring(norm, F.lit(1), kept), F.substring(norm, kept + 1, last - kept)
    # an IBAN's check digits are no part of what the moves depend on
    hashed = F.when(kind == "iban", F.concat(F.substring(norm, 1, 2), F.lit("00"))).otherwise(begin)
    new = F.when(kind == "ipv4", walk(F.split(rest, r"\."), begin, octet)).otherwise(walk(F.split(rest, ""), hashed, letter(_hexadecimal(kind, norm))))
    return F.when(kind == "card", _luhn(F.concat(new, F.lit("0")))).when(kind == "iban", _iban(new)).otherwise(new)


def assign_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct entities (kind, norm) with the attempt that gives each a surrogate of its own, and that surrogate.

    The attempt of a permuted entity is -1. Each round writes the entities that are still drawn, and
    ends with fewer: at most every second draw fails, whatever the number of entities.
    """
    draw = lambda df: df.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt")))
    entities = written(entities.select("kind", "norm").distinct(), "entities")
    formatted = entities.withColumn("format", _format(F.col("kind"), F.col("norm"))).select("*", "format.*").where("format is not null")
    count = formatted.groupBy("kind", "kept", "classes").count()
    crowded = written(count.where(F.log2(F.col("count") * CROWDED) > _bits(F.col("classes"))).drop("count"), "crowded")
    drawn, settled = entities.withColumn("attempt", F.lit(0)), []
    if crowded.limit(1).count():
        full = formatted.join(crowded, ["kind", "kept", "classes"]).select("kind", "norm", F.lit(-1).alias("attempt"), permuted(key, F.col("kind"), F.col("norm")).alias("surrogate"))
        settled.append(written(full, "permuted"))
        drawn = drawn.join(settled[0], ["kind", "norm"], "left_anti")
    originals = entities.select("kind", F.col("norm").alias("surrogate"))
    first = Window.partitionBy("kind", "surrogate").orderBy("norm")
    while True:
        taken = reduce(DataFrame.unionAll, (s.select("kind", "surrogate") for s in settled), originals).distinct().withColumn("taken", F.lit(True))
        judged = draw(drawn).join(taken, ["kind", "surrogate"], "left")
        again = F.col("taken").isNotNull() | (F.row_number().over(first) > 1)
        judged = written(judged.select("kind", "norm", "attempt", "surrogate", again.alias("again")), "drawn")
        settled.append(judged.where("not again").drop("again"))
        drawn = judged.where("again").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        if not drawn.limit(1).count():
            return reduce(DataFrame.unionAll, settled)


def _surnames(mentions: Column) -> Column:
    """A regular expression for the first surnames of a document's mentions of persons as words of their own; null without any."""
    # get: a title and a listed given name make a mention without a surname, too
    first = lambda m: F.get(F.filter(person_words(m), lambda w: w["kind"] == "surname"), F.lit(0))["word"]
    names = F.array_distinct(F.filter(F.transform(F.filter(mentions, lambda m: kind_of(m) == "person"), first), lambda n: n.isNotNull()))
    # longer ones first, as one may begin another
    ordered = F.transform(F.reverse(F.array_sort(F.transform(names, lambda n: F.struct(F.length(n), n.alias("n"))))), lambda s: s["n"])
    return F.when(F.size(names) > 0, F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}'’-])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])")))


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` (with doc_id and text) with surrogates in ``text``, and the columns n_entities and entity_kinds."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, KEY)
    text = F.col("text")
    found = _searched(text, lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    # explode_outer: for explode, the optimizer would search every text a second time in a filter on the array's size
    mentions = docs.select(F.xxhash64("text").alias("_redrawn_in"), F.explode_outer(F.array_distinct(found)).alias("m")).where("m is not null")
    of = written(mentions.select("_redrawn_in", F.explode(entities_of(F.col("m"))).alias("e")).select("_redrawn_in", "e.*"), "mentions")
    redrawn = assign_surrogates(of, key).where("attempt <> 0").select("kind", "norm", "surrogate")
    # a map has at most the entities of a text; texts of equal hashes share one
    by_text = written(
        of.distinct()
        .join(redrawn, ["kind", "norm"])
        .groupBy("_redrawn_in")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u001f", "kind", "norm"), "surrogate"))).alias("_redrawn")),
        "redrawn",
    )
    kept = [c for c in docs.columns if c not in ("text", "n_entities", "entity_kinds", "_redrawn", "_mentions", "_surnames", "_pieces", "_again", "_redrawn_in")]
    docs = docs.select(*kept, "text")
    chars = F.aggregate(F.map_entries("_redrawn"), F.lit(16).cast("long"), lambda a, e: a + F.length(e["key"]) + F.length(e["value"]))
    size = by_text.agg(F.sum(chars)).first()[0]
    if size:
        side = F.broadcast(by_text) if size <= BROADCAST_CHARS else by_text
        docs = docs.join(side, F.xxhash64("text") == F.col("_redrawn_in"), "left")
    else:
        docs = docs.withColumn("_redrawn", F.lit(None).cast("map<string,string>"))
    docs = docs.withColumn("_mentions", F.coalesce(found, F.array().cast("array<string>")))
    docs = docs.withColumn("_surnames", _surnames(F.col("_mentions")))
    pieces = F.when(F.size("_mentions") > 0, _searched(text, lambda pattern: F.split(text, pattern, -1)))
    docs = docs.withColumn("_pieces", pieces)
    again = F.transform("_pieces", lambda p: F.regexp_extract_all(p, F.col("_surnames"), F.lit(0)))
    docs = docs.withColumn("_again", F.coalesce(F.when(F.col("_surnames").isNotNull(), again), F.array().cast("array<array<string>>")))
    new = lambda m: render(key, m, F.col("_redrawn"))
    joined = lambda parts, ms: F.zip_with(parts, F.transform(ms, new), lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    between = lambda p, ms: F.when(F.size(ms) > 0, F.array_join(joined(F.split(p, F.col("_surnames"), -1), ms), "")).otherwise(p)
    kinds = F.filter(F.transform("_mentions", kind_of), lambda k: k != PLAIN)
    return docs.select(
        *kept,
        F.when(F.size("_mentions") > 0, F.array_join(joined(F.zip_with("_pieces", "_again", between), F.col("_mentions")), "")).otherwise(text).alias("text"),
        (F.size(kinds) + F.size(F.flatten("_again"))).alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("entity_kinds"),
    )


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the entities found in it."""
    return replace_entities(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates in their texts."""
    columns = docs.columns
    return replace_entities(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)
