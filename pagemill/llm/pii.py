"""Personal data: surrogates, with DataFrame functions only.

Entities (`KINDS`) are found by one pattern that starts at a word's edge; a name that stands in a text with a title is
found there without it too. An entity has one part, a person with a given name two, and a part has a canonical form:
a phone number its national digits, a card, a bank account or a number its signs without spacing, a mail address its
small letters, a person the family name and the given name by themselves. Surrogates are made of parts, from a keyed
SHA-256 stream, and then written in the form of each mention; so 'Mr. Anton Berg' and 'Mr. Berg', or one number in three
spellings, stay one (coreference), wherever in the corpus they stand.

A surrogate keeps type, script and form: digits stay digits, capitals capitals, small letters small letters, spacing
stays, letters of other scripts than Latin and Cyrillic become Latin ones; a card keeps its issuer digits and its check sum, a bank account its country and valid check digits, an address
of four octets stays one, a phone number its country code, a mail address its top-level domain (its domain is replaced
alike wherever it occurs); a name keeps its title and its particles (van, de), and given names follow the title's gender.

Two parts must not share a surrogate, and none may equal a part of the corpus: the distinct parts are gathered and
grouped by surrogate, and those that clash get a stream with the next number, until none is left; names get longer
from number to number. A part that still clashes at number `MOST_ROUNDS` (its kind's forms are used up) gets a
mark, # and 16 hexadecimal digits. Numbers other than zero are joined back to the texts that hold such a part.

Defined cases: a null text stays null, an empty one empty; texts may be of any length and are searched whole; where two
kinds fit at one place the first of `KINDS` is taken; of parts that clash the first in order keeps its surrogate;
repeated rows get equal results; no rows give no rows; rows may lack a doc_id; extra columns, whatever their names, pass
through `replace_pii` untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import free_name, stored

#: Given names by gender and script from which surrogates are made (fixed values of this operator).
NAMES = {
    ("m", "latin"): ["Adrian", "Bruno", "Casper", "Dario", "Edgar", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Konrad", "Leon", "Marius", "Nestor", "Oscar", "Pablo"],
    ("f", "latin"): ["Alma", "Bianca", "Carla", "Daria", "Elisa", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Lena", "Marta", "Nora", "Olga", "Paula"],
    ("m", "cyrillic"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"],
    ("f", "cyrillic"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина"],
}
#: Syllables of other surrogate names, by script, and the ends of given names by gender.
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ra", "se", "ti", "vo", "wa", "ze", "lu"], "cyrillic": ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ха"]}
ENDS = {("m", "latin"): "n", ("f", "latin"): "na", ("m", "cyrillic"): "н", ("f", "cyrillic"): "на"}
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "Госпожа"]
#: Titles that tell no gender; given names after them count as male ones.
OTHER_TITLES = ["Dr", "Prof", "Professor", "Sir"]
#: Small words inside family names, which stay.
PARTICLES = ["van", "von", "de", "der", "den", "del", "della", "di", "da", "du", "dos", "la", "le", "ten", "ter", "zu", "zur"]
_TITLE = "|".join([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES])
#: A capital (or O', D' and one), a small letter, and all letters that follow; a hyphen and another such word may.
_NAME = r"\p{Lu}(?:['\u2019]\p{Lu})?\p{Ll}\p{L}*+(?:-\p{Lu}\p{L}*+)?"
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
_PERSON = rf"(?:{_TITLE})\.? (?:{_NAME} )?{_PARTICLES}{_NAME}"

#: Patterns by kind, in the order in which they are tried, each with what a text has to hold: literals, or None for a digit.
KINDS: dict[str, tuple[list[str] | None, str]] = {
    "secret": (["=", ":"], r"(?i:password|passwd|secret|token|api[_-]?key) ?[=:] ?\"?(?=(?:\.?[A-Za-z0-9+/_-]){8})[A-Za-z0-9+/_-]++(?:\.[A-Za-z0-9+/_-]++)*+"),
    "email": (["@"], r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"),
    "access_key": (["AKIA", "ASIA"], r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "iban": (None, r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "card": (None, r"(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)"),
    "ip": (None, r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    "ssn": (None, r"\d{3}-\d{2}-\d{4}(?!\d)"),
    "phone": (None, r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|0\d{2,4}[ /-]\d{5,8}(?!\d)"),
    "address": (None, rf"\d{{1,5}} (?:{_NAME} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd)(?![\p{{L}}\p{{N}}])|\p{{Lu}}\p{{Ll}}+(?:straße|strasse|gasse|allee) \d{{1,4}}[a-z]?(?![\p{{L}}\p{{N}}])"),
    "person": ([t + end for t in (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES) for end in (" ", ". ")], _PERSON),
}
_EDGE = r"(?<![\p{L}\p{N}_.%+@-])"
_ANY = _EDGE + "(?:" + "|".join(p for _, p in KINDS.values())
PATTERN = _ANY + ")"
#: Numbers tried for a part before it gets a mark.
MOST_ROUNDS = 48


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def suspect(text: Column) -> Column:
    """Whether a text can hold an entity; cheap next to the pattern, and made from `KINDS`."""
    hit = text.rlike("[0-9]")
    for sign in dict.fromkeys(s for literals, _ in KINDS.values() for s in literals or ()):
        if sign not in ("=", ":"):
            hit = hit | text.contains(sign)
    return F.coalesce(hit | text.rlike("(?i:password|passwd|secret|token|key) ?[=:]"), F.lit(False))


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^(?:{_TITLE})\.? ", 0)


def _full_names(text: Column) -> Column:
    """Given and family names that stand in a text with a title, each with the title before it."""
    held = F.lit(False)
    for sign in KINDS["person"][0]:
        held = held | text.contains(sign)
    return F.when(held, F.filter(F.regexp_extract_all(text, F.lit(_EDGE + rf"({_PERSON})"), F.lit(1)), lambda e: e.rlike(rf"^(?:{_TITLE})\.? {_NAME} {_PARTICLES}{_NAME}$"))).otherwise(F.array().cast("array<string>"))


def _pattern(names: Column) -> Column:
    """The pattern for a text that holds these names (letters, hyphens, apostrophes and spaces) with titles."""
    bare = F.array_distinct(F.transform(names, lambda e: F.substring(e, F.length(_title(e)) + 1, F.length(e))))
    return F.when(F.size(names) > 0, F.concat(F.lit(_ANY + "|(?:"), F.array_join(bare, "|"), F.lit(r")(?![\p{L}\p{N}]))"))).otherwise(PATTERN)


def kind_of(entity: Column) -> Column:
    out = F.lit("person")
    for kind, (_, pattern) in reversed(KINDS.items()):
        out = F.when(entity.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _value_at(secret: Column) -> Column:
    return F.length(F.regexp_extract(secret, r"^(?i:[a-z_-]+) ?[=:] ?\"?", 0))


def _national(phone: Column) -> Column:
    """A number's digits without country code or the zero before an area code."""
    code = F.regexp_extract(phone, r"^\+(?:1(?=\d{10}$)|\d{1,3}(?=[ .(-])|\d{2})", 0)
    return F.regexp_replace(_digits(F.substring(phone, F.length(code) + 1, F.length(phone))), "^0(?=[0-9]{3})", "")


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _person_parts(entity: Column, names: Column) -> Column:
    """Of a person, titled or named in full: the family name, and the given name with its gender."""

    def of(title: Column) -> Column:
        words = F.filter(F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " "), lambda w: ~w.isin(PARTICLES))
        whose = F.when(title != "", title).otherwise(_title(F.filter(names, lambda e: e.endswith(F.concat(F.lit(" "), entity)))[0]))
        gender = F.when(F.regexp_replace(whose, r"[. ]", "").isin(FEMALE_TITLES), "f").otherwise("m")
        family = F.concat(F.lit("family|"), F.element_at(words, -1))
        return F.when(F.size(words) > 1, F.array(family, F.concat(F.lit("given"), gender, F.lit("|"), words[0]))).otherwise(F.array(family))

    return _let(_title(entity), of)


def parts_of(entity: Column, kind: Column, names: Column) -> Column:
    """The parts of an entity: 'class|canonical form', the first decides most."""
    bare = F.regexp_replace(entity, "[ -]", "")
    canon = (
        F.when(kind == "secret", F.substring(entity, _value_at(entity) + 1, F.length(entity))).when(kind == "email", F.lower(entity)).when(kind == "iban", bare)
        .when(kind.isin("card", "ssn"), _digits(entity)).when(kind == "phone", _national(entity)).otherwise(entity)
    )
    return F.when(kind == "person", _person_parts(entity, names)).otherwise(F.array(F.concat(kind, F.lit("|"), canon)))


def entities(text: Column) -> Column:
    """The entities of a text, in order: entity, kind and parts."""
    kind = "array<struct<entity:string,kind:string,parts:array<string>>>"

    def found(names: Column) -> Column:
        described = lambda e: _let(kind_of(e), lambda k: F.struct(e.alias("entity"), k.alias("kind"), parts_of(e, k, names).alias("parts")))
        return F.transform(F.regexp_extract_all(text, _pattern(names), F.lit(0)), described)

    return F.when(suspect(text), _let(_full_names(text), found)).otherwise(F.array().cast(kind))


def _stream(key: str, part: Column, number: Column) -> Column:
    """384 hexadecimal digits drawn from the key, the part and the number."""
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(i)), number.cast("string"), part).cast("binary"), 256) for i in range(6)])


def _draw(stream: Column, i: Column, n: int) -> Column:
    """A number below n from place i of a stream."""
    return (F.conv(F.substring(stream, F.pmod(i * 3, F.lit(372)) + 1, F.lit(6)), 16, 10).cast("long") % n).cast("int")


def _alike(part: Column, stream: Column, keep: int = 0, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Sign by sign, from place `keep` on, another of the same class."""

    def other(c: Column, i: Column) -> Column:
        pick = lambda signs: F.substring(F.lit(signs), _draw(stream, i, len(signs)) + 1, F.lit(1))
        low = pick("0123456789abcdef") if letters == "hex" else pick(letters)
        digit = low if letters == "hex" else pick("0123456789")
        return (
            F.when(i < keep, c).when(c.rlike("[0-9]"), digit).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike("[a-z]"), low)
            .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"\p{L}"), low).otherwise(c)
        )

    return F.array_join(F.transform(F.split(part, ""), other), "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum modulo 10."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _mod97(signs: Column) -> Column:
    """The number modulo 97 that digits and capitals (A is 10) spell."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(signs, ""), F.lit(0), step)


def _syllables(stream: Column, script: str, n: Column) -> Column:
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), _draw(stream, i, 16) + 1)), ""))


def made_of(part: Column, number: Column, key: str) -> Column:
    """The surrogate of a part in canonical form; another `number` gives another."""
    kind, canon = F.substring_index(part, "|", 1), F.substring(part, F.instr(part, "|") + 1, F.length(part))

    def family(stream: Column, script: str) -> Column:
        return _syllables(stream, script, F.lit(6) + F.floor(number / 2).cast("int"))

    def given(stream: Column, gender: str, script: str) -> Column:
        names = F.element_at(F.array(*map(F.lit, NAMES[gender, script])), _draw(stream, F.lit(40), len(NAMES[gender, script])) + 1)
        return F.when(number == 0, names).otherwise(F.concat(_syllables(stream, script, F.lit(3) + F.floor(number / 2).cast("int")), F.lit(ENDS[gender, script])))

    def by_script(make: Callable[[str], Column]) -> Column:
        return F.when(_script(canon) == "cyrillic", make("cyrillic")).otherwise(make("latin"))

    def of(stream: Column) -> Column:
        domain = F.substring_index(canon, "@", -1)
        top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
        body = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
        email = F.concat(_alike(F.substring_index(canon, "@", 1), stream), F.lit("@"), _let(_stream(key, domain, F.lit(0)), lambda s: _alike(body, s)), top)
        card = _let(_alike(canon, stream, 4), lambda raw: _let(F.concat(F.substring(raw, F.lit(1), F.length(raw) - 1), F.lit("0")), lambda zero: F.concat(F.substring(zero, F.lit(1), F.length(zero) - 1), F.pmod(_luhn(canon) - _luhn(zero), F.lit(10)).cast("string"))))
        iban = _let(_alike(F.substring(canon, F.lit(5), F.length(canon)), stream), lambda b: F.concat(F.substring(canon, 1, 2), F.lpad((F.lit(98) - _mod97(F.concat(b, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(stream, i, 254) + 1).cast("string")), ".")
        phone = F.concat((_draw(stream, F.lit(60), 8) + 2).cast("string"), F.substring(_alike(canon, stream), F.lit(2), F.length(canon)))
        street = F.regexp_extract(canon, r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd)$", 0)
        own = F.regexp_extract(canon, r"(straße|strasse|gasse|allee) (\d+)([a-z]?)$", 1)
        home = F.regexp_extract(canon, r"\d+", 0)
        number_ = F.concat((_draw(stream, F.lit(61), 9) + 1).cast("string"), F.substring(_alike(home, stream), F.lit(2), F.length(home)))
        address = F.when(street != "", F.concat_ws(" ", number_, _syllables(stream, "latin", F.lit(4)), street)).otherwise(F.concat(_syllables(stream, "latin", F.lit(4)), own, F.lit(" "), number_, F.regexp_extract(canon, r"[a-z]?$", 0)))
        hexed = canon.rlike("^[0-9a-f]+$")
        return (
            F.when(kind == "secret", F.when(hexed, _alike(canon, stream, 0, "hex")).otherwise(_alike(canon, stream))).when(kind == "email", email).when(kind == "access_key", _alike(canon, stream, 4))
            .when(kind == "iban", iban).when(kind == "card", card).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "address", address)
            .when(kind == "family", by_script(lambda s: family(stream, s))).when(kind == "givenf", by_script(lambda s: given(stream, "f", s))).when(kind == "givenm", by_script(lambda s: given(stream, "m", s)))
            .otherwise(_alike(canon, stream))
        )

    return F.when(number >= MOST_ROUNDS, F.concat(F.lit("#"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mark"), part).cast("binary"), 256), 1, 16))).otherwise(_let(_stream(key, part, number), of))


def _filled(entity: Column, made: Column, signs: str) -> Column:
    """entity with its last signs of a class replaced, in order, by those of `made`."""
    count = lambda x: F.length(F.regexp_replace(x, f"[^{signs}]", ""))

    def placed(first: Column) -> Column:
        other = lambda c, i: _let(count(F.substring(entity, F.lit(1), i)) - first, lambda j: F.when(c.rlike(f"[{signs}]") & (j >= 0), F.substring(made, j + 1, F.lit(1))).otherwise(c))
        return F.array_join(F.transform(F.split(entity, ""), other), "")

    return _let(count(entity) - F.length(made), placed)


def written(entity: Column, kind: Column, made: Column) -> Column:
    """The surrogate in the form of a mention. made: surrogates of the entity's parts."""
    one = made[0]
    cased = F.array_join(F.zip_with(F.split(entity, ""), F.split(one, ""), lambda c, m: F.when(c.rlike("[A-Z]"), F.upper(m)).otherwise(m)), "")
    person = F.concat(_title(entity), F.when(F.size(made) > 1, F.concat(made[1], F.lit(" "))).otherwise(""), F.regexp_extract(entity, rf"(?<= )({_PARTICLES})\S+$", 1), one)
    marked = F.when(kind == "secret", F.concat(F.substring(entity, F.lit(1), _value_at(entity)), one)).otherwise(one)
    return (
        F.when(kind == "person", person).when(one.startswith("#"), marked).when(kind == "secret", marked).when(kind == "email", cased)
        .when(kind.isin("card", "ssn", "phone"), _filled(entity, one, "0-9")).when(kind == "iban", _filled(entity, one, "0-9A-Z")).otherwise(one)
    )


def part_numbers(documents: DataFrame, key: str) -> DataFrame:
    """part and number of those parts whose first surrogate clashes with another's or with a part of the corpus."""
    of = lambda part, made: F.concat(F.regexp_replace(F.substring_index(part, "|", 1), "^given.$", "given"), F.lit("|"), made)
    canon = F.substring(F.col("part"), F.instr("part", "|") + 1, F.length("part"))
    every = documents.where(suspect(F.col("text"))).select(F.explode(F.flatten(F.transform(entities(F.col("text")), lambda e: e["parts"]))).alias("part")).distinct()
    made = lambda number: of(F.col("part"), made_of(F.col("part"), number, key))
    named = stored(every.select("part", of(F.col("part"), canon).alias("own"), F.lit(0).alias("number"), made(F.lit(0)).alias("made")), "parts")
    for _ in range(MOST_ROUNDS):
        twice = named.groupBy("made").agg(F.count("*").alias("n"), F.min("part").alias("first")).where("n > 1")
        taken = named.select(F.col("own").alias("made"), F.lit(True).alias("taken")).distinct()
        clash = stored(named.join(twice, "made", "left").join(taken, "made", "left").where((F.col("n").isNotNull() & (F.col("part") != F.col("first"))) | F.col("taken").isNotNull()).select("part", "own", "number"), "clashes")
        if clash.isEmpty():
            break
        moved = clash.select("part", "own", (F.col("number") + 1).alias("number")).withColumn("made", made(F.col("number")))
        named = stored(named.join(clash.select("part"), "part", "left_anti").union(moved), "parts")
    return named.where("number > 0").select("part", "number")


def replace_pii(documents: DataFrame, key: str) -> DataFrame:
    """documents with surrogates for the entities in text, and the column n_entities (with an underscore where a column has that name)."""
    columns = documents.columns
    own = [f"c{i}" for i in range(len(columns))]
    text = F.col(own[columns.index("text")])
    numbers = part_numbers(documents.select("text"), key)
    rows = documents.toDF(*own)
    if numbers.isEmpty():
        held = [rows.withColumn("numbers", F.lit(None).cast("map<string,int>"))]
    else:
        # only texts that may hold an entity are dealt out; equal ones meet once
        open_rows = rows.where(suspect(text)).withColumn("of", F.sha2(text.cast("binary"), 256))
        parts = open_rows.select("of", F.explode(F.array_distinct(F.flatten(F.transform(entities(text), lambda e: e["parts"])))).alias("part")).distinct()
        per_text = parts.join(numbers, "part").groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("part", "number"))).alias("numbers"))
        held = [open_rows.join(per_text, "of", "left").drop("of"), rows.where(~suspect(text)).withColumn("numbers", F.lit(None).cast("map<string,int>"))]

    def put(rows: DataFrame) -> DataFrame:
        surrogate = lambda p: made_of(p, F.coalesce(F.try_element_at(F.col("numbers"), p), F.lit(0)), key)
        made = F.transform("found", lambda e: written(e["entity"], e["kind"], F.transform(e["parts"], surrogate)))
        gaps = F.split(text, _let(_full_names(text), _pattern), -1)
        whole = F.when(F.size("found") > 0, F.array_join(F.zip_with(gaps, F.concat(made, F.array(F.lit(""))), lambda gap, new: F.concat(gap, new)), "")).otherwise(text)
        found = rows.withColumn("found", entities(text))
        return found.select(*[whole.alias(n) if c == "text" else F.col(n) for c, n in zip(columns, own, strict=True)], F.size("found").alias("n"))

    out = put(held[0]) if len(held) == 1 else put(held[0]).unionByName(put(held[1]))
    return out.toDF(*columns, free_name("n_entities", columns))
