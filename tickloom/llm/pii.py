"""Personal data replaced by surrogates of the same type and format.

Entities are found by patterns.  An entity is cut into atoms (the mailbox and
the host of an address, the words of a name, else the whole value), and each
atom gets a surrogate by a keyed permutation of its form: digits stay digits,
letters stay letters of their alphabet, vowels stay vowels in names, and so do
the lengths, country codes, card and account check digits, name endings and
separators; a value without any character that may change is replaced by letters
of a keyed hash.  So a surrogate is the same wherever its entity occurs
(coreference, also of parts: Mr. Smith keeps the family name of Mr. John Smith),
nobody without the key can tell what it stood for, and no two entities share
one: permutations have no collisions, whatever the number of entities.

A surrogate that is itself an entity of the corpus is drawn again, from another
permutation, until it is neither an entity nor taken.  Where the corpus has
over a quarter of all values of a form (say 20 one-letter names), the form's
values are permuted as they are, so that a surrogate may be the value of
another entity.  A value never stands for itself.

Only DataFrame expressions are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.permute import permuted
from tickloom.llm.scratch import doc_key, put

#: The session's setting for the secret key.
KEY_SETTING = "spark.tickloom.pii.key"
_MEN = "Mr|MR|Mister|MISTER|Herr|HERR|Herrn|Monsieur|MONSIEUR|Señor|SEÑOR|Don|Sir|SIR|Господин|г-н"
_WOMEN = "Mrs|MRS|Ms|MS|Miss|MISS|Madam|MADAM|Frau|FRAU|Madame|MADAME|Mme|Mademoiselle|Señora|SEÑORA|Señorita|Doña|Госпожа|г-жа"
#: Titles that tell no gender; they may also follow those that do.
_LEARNED = "Dr|DR|Prof|PROF|Professor|PROFESSOR|Professeur|Doctor|DOCTOR|Docteur|Доктор|Профессор"
_WORD = r"[\p{Lu}\p{Lo}][\p{L}\p{M}'’-]*+"
#: Kinds in the order in which they are tried at one place; fixed patterns.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}.-]+\.\p{L}[\p{L}\p{M}]+",
    "secret": r"(?:\b(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})\b|\bAKIA[0-9A-Z]{16}\b|\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,})",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b(?!\.\d)",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){3,7}:)(?![\w:])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b(?:\d[ -]?){12,15}\d\b",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?|\d{1,4}[ .-])\d{3,4}(?:[ .-]?\d{2,4}){1,3}\b|\+[1-9]\d{7,14}\b|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}-\d{3}-\d{4}\b|(?<![\d.])\d{3}\.\d{3}\.\d{4}\b(?!\.\d)|(?<![\w.,/-])0\d{2,4}(?: ?/ ?|[ -])\d{3,8}(?:[ -]\d{2,4})?\b(?![.,/-]?\d))",
    "ssn": r"\b\d{3}(?:-\d{2}-|(?<![\d.,] \d{3}) \d{2} )\d{4}\b(?! ?\d)",
    "man": rf"\b(?:{_MEN})\.? (?:(?:{_LEARNED})\.? )*{_WORD}(?: {_WORD}){{0,2}}",
    "woman": rf"\b(?:{_WOMEN})\.? (?:(?:{_LEARNED})\.? )*{_WORD}(?: {_WORD}){{0,2}}",
    "person": rf"\b(?:{_LEARNED})\.? (?:(?:{_LEARNED})\.? )*{_WORD}(?: {_WORD}){{0,2}}",
}
#: Found by a pattern, and yet no entity: digits like a card's whose check digit is wrong.
NONE = "none"
ANY = "|".join(PATTERNS.values())
#: Every entity has a digit, an at-sign, a title or the start of a secret: texts without are not searched further.
HINT = rf"[0-9@]|::|\b(?:{_MEN}|{_WOMEN}|{_LEARNED})\b|AKIA|\b(?:sk|pk|ghp|gho|xox[abp])[-_]|\b(?:[a-f]{{32}}|[A-F]{{32}})"
_TITLE = rf"^(?:(?:{_MEN}|{_WOMEN}|{_LEARNED})\.? )+"
#: Given names that stand for one another; all others keep their last letter, which often tells the gender.
NAMES = {
    ("man", "latin"): "James John Peter Martin Thomas Daniel Oscar Victor Hugo Simon Leon Adam Felix Paul Louis Marco Nils".split(),
    ("woman", "latin"): "Anna Clara Maria Laura Emma Julia Elena Sofia Nora Alice Irene Paula Marta Lucy Helen Ines".split(),
    ("man", "cyrillic"): "Иван Пётр Олег Борис Павел Антон Игорь Юрий".split(),
    ("woman", "cyrillic"): "Анна Мария Елена Ольга Ирина Нина Вера Юлия".split(),
}
_PREFIX = r"^(?:AKIA|(?:sk|pk|ghp|gho|xox[abp])[-_])"
#: Calling codes of countries: fixed values.
_CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Endings of Cyrillic family names.
_ENDING = "(?:ова|ева|ёва|ина|ына|ская|цкая|ов|ев|ёв|ин|ын|ский|цкий)$"

DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Vowels and consonants, with and without marks.
_LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœąęěőůűāăēĕėĩīĭįıōŏũūŭųŷ", "çñßþćčďłńňřśšťźżžðĉċđĝğġģĥħĵķĺļŋŕŗŝşţŧŵ", "аеёиоуыэюяіїєў", "бвгджзйклмнпрстфхцчшщґђљњћџ", "கஙசஜஞடணதநனபமயரறலளழவஷஸஹ")
#: Further scripts, as ranges of code points: Greek, Armenian, Hebrew, Arabic, Devanagari, Bengali, Gurmukhi, Gujarati,
#: Telugu, Kannada, Malayalam, Thai, Burmese, Georgian, Ethiopic, Khmer, kana, Chinese, Korean.
_RANGES = ((0x3B1, 0x3C9), (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x915, 0x939), (0x995, 0x9A8), (0xA15, 0xA28), (0xA95, 0xAA8), (0xC15, 0xC28), (0xC95, 0xCA8), (0xD15, 0xD28), (0xE01, 0xE2E), (0x1000, 0x1020), (0x10D0, 0x10F0), (0x1208, 0x1246), (0x1780, 0x17A2), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
#: For kinds of atoms the alphabets whose letters may change; the last are for values of signs alone.
_ALPHABETS = {
    ("card", "phone", "ssn"): (DIGITS,),
    ("iban",): (DIGITS, UPPER),
    ("hex", "ip6"): (HEX,),
    ("token",): (DIGITS, LOWER, UPPER),
    ("local", "host"): (DIGITS, LOWER, *_LETTERS[2:], *_RANGES),
    ("given", "surname"): (*_LETTERS, *_RANGES),
    ("signs-token",): ("-_",),
    ("signs-local",): (".-_%+",),
    ("signs-host",): (".-",),
}
_EACH = [*dict.fromkeys(a for some in _ALPHABETS.values() for a in some)]
PEOPLE = ("man", "woman", "person")
#: Atoms whose surrogates may be real: mailboxes (their hosts are not) and names from the lists.
UNCHECKED = ("local", "listed-man", "listed-woman")


def secret_key(spark: SparkSession, key: str | None = None) -> str:
    """``key``, or the session's setting; there is no default."""
    key = key or spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a secret key")
    return key


def kind_of(found: Column) -> Column:
    """The first kind that matches; a card must also have the right check digit."""
    is_a = lambda kind: found.rlike(f"^(?:{PATTERNS[kind]})$")
    out = F.when(is_a("card"), NONE).otherwise("person")
    for kind in reversed([k for k in PATTERNS if k != "person"]):
        met = is_a(kind) & (_luhn(F.regexp_replace(found, r"\D", "")) % 10 == 0) if kind == "card" else is_a(kind)
        out = F.when(met, kind).otherwise(out)
    return out


def canonical(kind: Column, found: Column) -> Column:
    """What two spellings of one entity share."""
    digits = F.regexp_replace(found, r"\D", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(found.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.replace(found, F.lit(" "), F.lit("")))
        .when(kind.isin(*PEOPLE), F.lower(F.regexp_replace(found, _TITLE, "")))
        .when(kind.isin("email", "ip6"), F.lower(found))
        .when((kind == "secret") & found.rlike("^[0-9A-Fa-f]+$"), F.lower(found))
        .otherwise(found)
    )


def has_any(text: Column) -> Column:
    """Whether a text has an entity; null counts as none."""
    return F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))


def scanned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, id, row, plain, gaps, found`` of every row, in one pass over the texts.

    A text without an entity is in ``plain``; of others there are the entities,
    as ``kind, raw``, and the texts around them, one more than entities.
    """
    body = F.col(text).cast("string")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), doc_key(doc_id).alias("id"), F.xxhash64(body).alias("row"), body.alias("text"), has_any(body).alias("hit"))
    raw = F.when(F.col("hit"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    found = F.transform(raw, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("raw")))
    return own.select("doc_id", "id", "row", F.when(~F.col("hit"), F.col("text")).alias("plain"), F.when(F.col("hit"), F.split("text", ANY, -1)).alias("gaps"), found.alias("found"))


def entities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, row, gaps, found`` of the texts with an entity."""
    return scanned(docs, text, doc_id).where("found IS NOT NULL").select("id", "row", "gaps", "found")


def atoms(kind: Column, value: Column) -> Column:
    """The parts of a canonical entity that have surrogates of their own."""
    part = lambda k, v: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), v.alias("value"))
    words = F.split(value, " ")

    def named(*genders: str) -> Column:
        def kind_of_given(w: Column) -> Column:
            out = F.lit("given")
            for gender in genders:
                out = F.when(w.isin([n.lower() for (g, _), names in NAMES.items() if g == gender for n in names]), f"listed-{gender}").otherwise(out)
            return out

        given = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: part(kind_of_given(w), w))
        return F.concat(given, F.array(part("surname", F.element_at(words, -1))))

    return (
        F.when(kind == "email", F.array(part("local", value), part("host", F.substring_index(value, "@", -1))))
        .when(kind == "secret", F.array(part(F.when(value.rlike("^[0-9a-f]+$"), "hex").otherwise("token"), value)))
        .when(kind == "man", named("man"))
        .when(kind == "woman", named("woman"))
        .when(kind == "person", named("man", "woman"))
        .otherwise(F.array(part(kind, value)))
    )


def _digit_sum(digits: Column) -> Column:
    return sum((d * (F.length(digits) - F.length(F.replace(digits, F.lit(str(d)), F.lit("")))) for d in range(1, 10)), F.lit(0))


def _luhn(digits: Column) -> Column:
    """The sum of the check-digit rule for an even number of digits or odd: every
    second digit from the right but one counts double, its own digits summed."""
    even = F.when(F.length(digits) % 2 == 0, digits).otherwise(F.concat(F.lit("0"), digits))
    doubled = F.translate(F.regexp_replace(even, "(.)(.)", "$1"), "123456789", "246813579")
    return _digit_sum(doubled) + _digit_sum(F.regexp_replace(even, "(.)(.)", "$2"))


def _mod97(value: Column) -> Column:
    """The remainder of a number in which A to Z stand for 10 to 35."""
    digit = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(F.split(value, ""), F.lit(0), lambda n, c: F.when(digit(c) < 10, n * 10 + digit(c)).otherwise(n * 100 + digit(c)) % 97)


def _coded(kind: Column, body: Column) -> Column:
    """For each character its alphabet, place and radix; a fixed one has radix 1."""
    entry = lambda c, k, s, r: F.struct(F.lit(k).alias("k"), s.cast("int").alias("s"), F.lit(r).alias("r"), c.alias("c"))

    def code(alphabets: tuple) -> Column:
        def of(c: Column) -> Column:
            out = entry(c, -1, F.lit(0), 1)
            for a in reversed(alphabets):
                if isinstance(a, str):
                    out = F.when((c != "") & (F.instr(F.lit(a), c) > 0), entry(c, _EACH.index(a), F.instr(F.lit(a), c) - 1, len(a))).otherwise(out)
                else:
                    out = F.when(F.ascii(c).between(*a), entry(c, _EACH.index(a), F.ascii(c) - a[0], a[1] - a[0] + 1)).otherwise(out)
            return out

        return F.transform(F.split(body, ""), of)

    signs = kind.isin("token", "local", "host") & ~body.rlike("[A-Za-z0-9]")
    kind = F.when(signs, F.concat(F.lit("signs-"), kind)).otherwise(kind)
    out = F.when(kind == "ip", _octets(body))
    for kinds, alphabets in _ALPHABETS.items():
        out = out.when(kind.isin(*kinds), code(alphabets))
    return out


def _decoded(coded: Column, symbols: Column) -> Column:
    def char(x: Column, i: Column) -> Column:
        s, out = F.get(symbols, i), x["c"]
        for k, a in enumerate(_EACH):
            out = F.when(x["k"] == k, F.substr(F.lit(a), s + 1, F.lit(1)) if isinstance(a, str) else F.decode(F.unhex(F.lpad(F.hex(s + a[0]), 8, "0")), "UTF-32")).otherwise(out)
        first, last = x["k"].isin(_OCTET[0], _OCTET[1]), x["k"] == _OCTET[3]
        number = F.when(x["k"] == _OCTET[2], s).when(first, s + 1).when(s == 0, 0).when(last, s + 254).otherwise(s + 223)
        return F.when(x["k"] >= _OCTET[0], number.cast("string")).otherwise(out)

    parts = F.transform(coded, char)
    return F.when(F.get(coded, F.lit(0))["k"] >= _OCTET[0], F.array_join(parts, ".")).otherwise(F.array_join(parts, ""))


#: Of an address: 1 to 223 in front, 1 to 254 at the end, any number between, and at the end or in front what is left.
_OCTET = (200, 201, 202, 203, 204)


def _octets(value: Column) -> Column:
    """The numbers of an address, each in the range it is in."""
    entry = lambda k, s, r: F.struct(F.lit(k).alias("k"), s.cast("int").alias("s"), F.lit(r).alias("r"), F.lit("").alias("c"))
    over = lambda x, most: F.greatest(x - most, F.lit(0))

    def of(c: Column, i: Column) -> Column:
        x = c.cast("int")
        first = F.when(x.between(1, 223), entry(_OCTET[0], x - 1, 223)).otherwise(entry(_OCTET[4], over(x, 223), 33))
        last = F.when(x.between(1, 254), entry(_OCTET[1], x - 1, 254)).otherwise(entry(_OCTET[3], over(x, 254), 2))
        return F.when(i == 0, first).when(i == 3, last).otherwise(entry(_OCTET[2], x, 256))

    return F.transform(F.split(value, r"\."), of)


def _listed(gender: str, value: Column, key: str) -> Column:
    """The next name of the list, in an order set by the key."""
    pairs = []
    for (g, _), names in NAMES.items():
        if g == gender:
            order = sorted((n.lower() for n in names), key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
            pairs += [F.lit(x) for two in zip(order, order[1:] + order[:1], strict=True) for x in two]
    return F.element_at(F.create_map(*pairs), value)


def _forms(values: DataFrame) -> DataFrame:
    """``values`` (``kind, value``) with ``head, body, tail`` (what is kept in front,
    permuted, and kept or worked out at the end) and the ``coded`` body."""
    kind, value, length = F.col("kind"), F.col("value"), F.length("value")
    head = (
        F.when(kind == "card", F.substr(value, F.lit(1), F.lit(1)))
        .when(kind == "iban", F.substr(value, F.lit(1), F.lit(2)))
        .when((kind == "phone") & value.startswith("+"), F.regexp_extract(value, _CALLING, 0))
        .when(kind == "phone", F.substr(value, F.lit(1), F.lit(1)))
        .when(kind == "token", F.regexp_extract(value, _PREFIX, 0))
        .otherwise("")
    )
    tail = (
        F.when(kind == "card", F.substr(value, length))
        .when(kind == "local", F.concat(F.lit("@"), F.substring_index(value, "@", -1)))
        .when(kind == "host", F.concat(F.lit("."), F.substring_index(value, ".", -1)))
        .when((kind == "given") & (length > 2), F.substr(value, length))
        .when((kind == "surname") & (length > 5), F.regexp_extract(value, _ENDING, 0))
        .otherwise("")
    )
    cut = values.withColumns({"head": head, "tail": tail})
    skipped = F.when(kind == "iban", 4).otherwise(F.length("head"))
    cut = cut.withColumn("body", F.substr(value, skipped + 1, length - skipped - F.length("tail")))
    return cut.withColumn("coded", _coded(kind, F.col("body")))


def surrogates(values: DataFrame, key: str, draw: int = 0) -> DataFrame:
    """``kind, value, made, form, room`` of atoms ``kind, value``.

    ``made`` is the surrogate (of a mailbox, without its host), ``form`` names
    the form and ``room`` is the logarithm of the number of its values.
    """
    kind, value, head, body, tail, made = map(F.col, ("kind", "value", "head", "body", "tail", "made"))
    # What the family names of a man and of a woman share is changed alike.
    tweak = F.concat_ws("|", F.lit(str(draw)), kind, head, F.when(~kind.isin("surname", "card"), tail))
    own = _forms(values).withColumns({"s": F.transform("coded", lambda x: x["s"]), "r": F.transform("coded", lambda x: x["r"]), "tweak": tweak})
    shape = F.transform("coded", lambda x: F.when(x["r"] > 1, F.concat_ws(":", x["k"].cast("string"), x["r"].cast("string"))).otherwise(x["c"]))
    form = F.md5(F.concat_ws("|", kind, head, F.when(kind != "card", tail), F.array_join(shape, ",")))
    room = F.aggregate("r", F.lit(0.0), lambda s, r: s + F.log(r.cast("double")))
    own = own.withColumns({"m": permuted(F.col("s"), F.col("r"), F.col("tweak"), key), "form": form, "room": room})
    own = own.withColumn("made", _decoded(F.col("coded"), F.col("m")))
    check = lambda b: (10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10
    last = F.pmod(check(F.concat(head, made)) + tail.cast("int") - check(F.concat(head, body)), F.lit(10))
    given = F.substr(value, F.lit(3), F.lit(2)).cast("int")
    # 98 less the remainder is the right number; a wrong one stays as far off.
    remainder = lambda b: _mod97(F.concat(b, head, F.lit("00")))
    right = F.pmod(given - 2 + remainder(body) - remainder(made), F.lit(97)) + 2
    number = F.lpad(F.when(given.between(2, 98), right).otherwise(given).cast("string"), 2, "0")
    # Where no character may change, the value goes: twelve letters of a keyed hash stand for it.
    hidden = F.translate(F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(draw)), kind, value), 256), F.lit(1), F.lit(12)), DIGITS, "ghijklmnop")
    whole = (
        F.when(kind == "card", F.concat(head, made, last.cast("string")))
        .when(kind == "iban", F.concat(head, number, made))
        .when(kind == "local", made)
        .when(kind == "listed-man", _listed("man", value, key))
        .when(kind == "listed-woman", _listed("woman", value, key))
        .when(F.col("room") == 0, hidden)
        .otherwise(F.concat(head, made, tail))
    )
    return own.select("kind", "value", whole.alias("made"), "form", "room")


def settled(made: DataFrame, key: str) -> DataFrame:
    """``kind, value, made`` in which no surrogate is a value of its kind.

    ``made``: first surrogates with their ``form``, distinct.  In forms of which
    the corpus has at most a quarter, surrogates that are values are drawn anew:
    each draw settles half of what is left at least, on average.  Fuller forms
    keep their first surrogates, which are distinct as well.
    """
    real = made.select("kind", F.col("value").alias("made"))
    hits = put(made.where(~F.col("kind").isin(*UNCHECKED)).join(real, ["kind", "made"], "left_semi"), "hits")
    if hits.isEmpty():
        return made.select("kind", "value", "made")
    sparse = made.join(hits.select("form").distinct(), "form").groupBy("form").agg(F.count("*").alias("n"), F.max("room").alias("room")).where("ln(4.0 * n) <= room")
    left = put(hits.join(sparse, "form", "left_semi").select("kind", "value"), "left")
    done = made.select("kind", "value", "made").join(left, ["kind", "value"], "left_anti")
    draw = 0
    while not left.isEmpty():
        draw += 1
        drawn = put(surrogates(left, key, draw).select("kind", "value", "made"), "drawn")
        free = put(drawn.join(real, ["kind", "made"], "left_anti").join(done.select("kind", "made"), ["kind", "made"], "left_anti").select("kind", "value", "made"), "free")
        done = done.union(free)
        left = put(left.join(free, ["kind", "value"], "left_anti"), "left")
    return done


def dictionary(found: DataFrame, key: str | None = None) -> DataFrame:
    """``kind, value, surrogate`` for the distinct ``kind, value`` of ``found``.

    No two entities of a kind share a surrogate; none is an entity itself but
    in forms of which the corpus has over a quarter.
    """
    key = secret_key(found.sparkSession, key)
    values = put(found.select("kind", "value").distinct(), "entities")
    parts = values.select("kind", "value", F.posexplode(atoms(F.col("kind"), F.col("value"))).alias("at", "atom"))
    spark = found.sparkSession
    # Listed names count as values of the given names, so that no other becomes one of them.
    listed = spark.createDataFrame([("given", n.lower()) for names in NAMES.values() for n in names], "kind string, value string")
    each = parts.select("atom.kind", "atom.value").union(listed.join(parts.select("atom.kind").distinct(), "kind", "left_semi")).distinct()
    made = put(surrogates(each, key), "surrogates")
    own = settled(made, key).select(F.struct("kind", "value").alias("atom"), "made")
    whole = parts.join(own, "atom").groupBy("kind", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "made"))), lambda x: x["made"]).alias("made"))
    return whole.select("kind", "value", F.when(F.col("kind") == "email", F.array_join("made", "@")).otherwise(F.array_join("made", " ")).alias("surrogate"))


def _cased(raw: Column, made: Column) -> Column:
    """``made`` in the case of ``raw``, letter by letter where lengths agree."""
    each = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c != F.lower(c), F.upper(F.substr(made, i + 1, F.lit(1)))).otherwise(F.substr(made, i + 1, F.lit(1)))), "")
    return F.when((raw == F.upper(raw)) & (F.length(raw) > 1) & (raw != F.lower(raw)), F.upper(made)).when(F.length(raw) == F.length(made), each).otherwise(F.initcap(made))


def bare(raw: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(raw, _TITLE, "")


def dress(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogate in the spelling of the occurrence; of a name, without the title."""
    digits = F.regexp_replace(made, r"\D", "")
    spread = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.between("0", "9"), F.substr(digits, F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(made, F.length(F.replace(F.substr(raw, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    named = F.array_join(F.zip_with(F.split(bare(raw), " "), F.split(made, " "), _cased), " ")
    hexed = F.when(raw == F.upper(raw), F.upper(made)).otherwise(made)
    return (
        F.when(kind.isin("card", "phone", "ssn"), spread)
        .when(kind == "iban", spaced)
        .when(kind.isin(*PEOPLE), named)
        .when(kind == "ip6", hexed)
        .when(kind == "email", _cased(raw, made))
        .when((kind == "secret") & raw.rlike("^[0-9A-Fa-f]+$"), hexed)
        .otherwise(made)
    )


def replacements(texts: DataFrame, key: str | None = None) -> DataFrame:
    """``id, row, gaps, made`` of stored :func:`entities`: for each entity in order
    ``at, kind, title, name, made``, ``name`` being a name of several words.
    """
    each = texts.select("id", "row", F.posexplode("found").alias("at", "e")).select("id", "row", "at", "e.kind", "e.raw").distinct()
    each = each.withColumn("value", canonical(F.col("kind"), F.col("raw")))
    real = each.where(F.col("kind") != NONE)
    # Stored, so that the join has an exchange of its own on both sides and a hot entity can be split.
    known = put(dictionary(real, key), "dictionary")
    named = real.join(known, ["kind", "value"]).unionByName(each.where(F.col("kind") == NONE).withColumn("surrogate", F.col("raw")))
    person = F.col("kind").isin(*PEOPLE)
    entry = F.struct(
        "at", "kind", F.when(person, F.regexp_extract("raw", _TITLE, 0)).otherwise("").alias("title"),
        F.when(person & F.col("value").contains(" "), bare(F.col("raw"))).alias("name"),
        dress(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("made"),
    )
    made = named.select("id", "row", entry.alias("e")).groupBy("id", "row").agg(F.array_sort(F.collect_list("e")).alias("made"))
    return texts.select("id", "row", "gaps").dropDuplicates(["id", "row"]).join(made, ["id", "row"])


def anonymise(docs: DataFrame, key: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_entities, kinds, clean_text`` for every row of ``docs``.

    ``kinds`` lists the kinds found, in order.  A name of several words that
    follows a title somewhere in a text is replaced there without one, too
    (these are not counted).  A null or empty text stays as it is, with no
    entities; repeated rows are replaced alike and all kept; a very long text is
    one row, searched whole.  An empty table gives no rows; other columns are
    not read.  Without a ``key`` the session must have one.
    """
    key = secret_key(docs.sparkSession, key)
    seen = put(scanned(docs, text, doc_id), "scanned")
    made = replacements(seen.where("found IS NOT NULL").select("id", "row", "gaps", "found"), key)
    names = F.array_distinct(F.transform(F.filter("made", lambda e: e["name"].isNotNull()), lambda e: F.struct(e["name"].alias("name"), e["made"].alias("made"))))
    pattern = lambda n: F.concat(F.lit(r"(?<![\p{L}\p{M}])\Q"), n["name"], F.lit(r"\E(?![\p{L}\p{M}])"))
    bared = F.when(F.size("names") > 0, F.transform("gaps", lambda g: F.aggregate("names", g, lambda s, n: F.regexp_replace(s, pattern(n), n["made"])))).otherwise(F.col("gaps"))
    made = made.withColumn("names", names).withColumn("gaps", bared)
    cleaned = made.select(
        "id", "row", F.filter(F.col("made.kind"), lambda k: k != NONE).alias("kinds"),
        F.concat(F.get("gaps", F.lit(0)), F.array_join(F.transform("made", lambda e, i: F.concat(e["title"], e["made"], F.get("gaps", i + 1))), "")).alias("clean"),
    )
    none = F.array().cast("array<string>")
    plain = seen.where("found IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_entities"), none.alias("kinds"), F.col("plain").alias("clean_text"))
    done = seen.where("found IS NOT NULL").select("doc_id", "id", "row").join(cleaned, ["id", "row"]).select("doc_id", F.size("kinds").cast("long").alias("n_entities"), "kinds", F.col("clean").alias("clean_text"))
    return plain.union(done)
