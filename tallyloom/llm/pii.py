"""Personal data replaced by surrogates, with DataFrame functions only.

Detected entities (e-mail, IPv4, card, social-security, IBAN and phone numbers, access keys and passwords, persons
after an honorific or a title, and their whole and family names where the same text has them alone) receive keyed replacements
of the same type, script and format: digits stay digits at the same places, letters keep their case, a card keeps its
first digit and a valid check digit, an IBAN its country and valid check digits, a mail address gets a reserved
domain, and a person's name one of the honorific's gender in the name's script.  Names in other scripts than
Cyrillic are written in Latin.

An entity's canonical form (for a phone its digits, for a mail address its lower-case form) decides its
surrogate, so all spellings of one entity stay together (coreference).  Family names have surrogates of their own, so
that "Mr John Smith", "Mr Smith", "Dr Smith" and a later "Smith" share one; invented names get longer with each
attempt, so there is one for every name.  The distinct entities are collected in a table; where two would get one
surrogate, or one the canonical form of another entity, all but the first get a further attempt, until none
collides (distinctness); what is settled isn't computed again.  The table grows with the distinct entities and is
never collected or broadcast.

Texts are put together again through their *list* of entities, so no row identifier is needed: rows with equal
lists share one row of replacements, and only texts that hold an entity are shuffled.

Defined cases: a null or empty text has no entity and is returned as it is; null ids, repeated rows and extra
columns pass through (a column named n_entities is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, new_name, partitions, read_table

#: Honorifics and what they say of gender (fixed values).
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа"]
#: Titles that stand for an honorific and leave the gender open (fixed values).
OPEN = ["Dr", "Prof", "Doctor", "Professor"]
#: Given names by gender and script (fixed values).
GIVEN = {
    ("m", "latin"): ["Adrian", "Bruno", "Conrad", "Daniel", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Julian", "Leon", "Martin", "Oscar", "Paul", "Robert", "Simon"],
    ("f", "latin"): ["Alma", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Marta", "Nora", "Paula", "Rosa", "Sofia"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Фёдор"],
    ("f", "cyrillic"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "София", "Тамара"],
}
#: Syllables of invented family names by script (fixed values).
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "tu", "va", "wen", "kor", "lin", "mar", "ton"],
    "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "ту", "ва", "вен", "кор", "лин", "мар", "тон"],
}
#: What names a secret that follows it.
_KEYWORD = "(?i:password|passwd|secret|api_key|token)"
_NAMED = _KEYWORD + r"[ \t]?[=:][ \t]?"
#: A secret's value: eight signs or more up to white space or the quote that opened it; closing punctuation isn't part of it.
_VALUE = r"(?:\"(?=[^\s\"]{8})[^\s\"]*+|'(?=[^\s']{8})[^\s']*+|(?=[^\s\"']\S{7})\S*[^\s.,;:!?)\]}>\"'])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HONORIFIC = "(?:" + "|".join(MALE + FEMALE + OPEN) + r")"
#: Titles after an honorific and small words inside a name (fixed values).
TITLES = ["Dr", "Prof", "Dipl", "Ing", "Mag", "Rev", "Hon", "St"]
PARTICLES = ["von", "van", "vom", "zu", "zum", "zur", "der", "den", "ter", "ten", "de", "del", "della", "di", "da", "do", "dos", "das", "du", "des", "la", "le", "las", "los", "y", "e", "bin", "ibn", "al", "el", "фон", "де"]
_GAP = r"[ \t\u00A0]++"
#: A name word (O'Brien, Meier-Schulz, d'Artagnan, without an English 's), and what may stand before it: titles,
#: initials, particles.  Loops over groups are possessive, which Java runs without recursion.
_WORD = r"(?:\p{Ll}{1,4}['’-](?=\p{Lu}))?+(?=\p{Lu}[\p{M}'’-]*\p{L})\p{Lu}[\p{L}\p{M}]*+(?:['’-](?!s(?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+"
_BEFORE = rf"(?:(?:{'|'.join(TITLES)})(?:\.[ \t\u00A0-]*+|{_GAP})|\p{{Lu}}\p{{M}}*+(?:\.[ \t\u00A0-]*+|{_GAP})|(?:{'|'.join(PARTICLES)}){_GAP})*+"
_NAME = rf"{_BEFORE}{_WORD}(?:{_GAP}{_BEFORE}{_WORD})*+(?:{_GAP}\p{{Lu}}\p{{M}}*+(?=\.))?+"
#: Types in order of precedence with their Java patterns; none has a capturing group.  None ends inside an entity:
#: runs have no upper bound but the one of their standard (a phone has 15 digits, an IBAN 34 characters).
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|" + _NAMED + _VALUE + ")",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}(?![A-Za-z0-9])",
    "ipv4": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d-])(?:\d{4}[ -]){3}\d{4}(?![\d-])|(?<![\d-])\d{15,16}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\dA-Za-z+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,6}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "person": rf"(?<![\p{{L}}])(?:{_HONORIFIC})\.? {_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity contains; a cheap first look at a text.
HINT = "[0-9@]|AKIA|" + _KEYWORD + "|" + _HONORIFIC + r"\.? "
MAX_ATTEMPTS = 64
#: Attempts that only choose among the given names; later ones add invented syllables.
LISTED = 4


_TITLED = rf"^(?:{_HONORIFIC})\.? "


def _bare(e: Column) -> Column:
    """A person's name without its honorific."""
    return F.when(e.rlike(_TITLED), F.regexp_replace(e, r"^\p{L}+\.? ", "")).otherwise(e)


def _type(e: Column) -> Column:
    out = F.when(e.rlike(_TITLED) | e.rlike(r"[\s\u00A0]"), F.lit("person")).otherwise(F.lit("family"))  # a family name is one word
    for name, p in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(e.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _gender(e: Column) -> Column:
    """m, f or u of a person's honorific."""
    of = lambda names: e.rlike(rf"^(?:{'|'.join(names)})\.? ")
    return F.when(of(MALE), "m").when(of(FEMALE), "f").otherwise("u")


def _family(name: Column) -> Column:
    """The last word of a name, initials left aside; white space parts words."""
    words = F.filter(F.split(name, r"[\s\u00A0]+"), lambda w: ~w.rlike(r"^\p{L}\p{M}*\.?$"))
    return F.coalesce(F.element_at(words, F.when(F.size(words) > 0, F.lit(-1))), F.element_at(F.split(name, r"[\s\u00A0]+"), -1))


def _canonical(kind: Column, e: Column) -> Column:
    d = _digits(e)
    return (
        F.when(kind.isin("card", "ssn"), d)
        .when(kind == "phone", F.when(F.length(d) == 10, F.concat(F.lit("1"), d)).otherwise(d))
        .when(kind == "email", F.lower(e))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "person", F.concat(_gender(e), F.lit(" "), F.lower(F.regexp_replace(_bare(e), _GAP, " "))))
        .when(kind == "family", F.lower(e))
        .when(kind == "secret", F.regexp_replace(e, "^" + _NAMED + "[\"']?", ""))
        .otherwise(e)
    )


def _stream(key: str, *parts: Column) -> Column:
    """128 hex characters that depend on the key and all parts."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 256)
    return F.concat(F.sha2(F.concat(F.lit(key), inner).cast("binary"), 256), F.sha2(F.concat(inner, F.lit(key)).cast("binary"), 256))


def _refill(shape: Column, h: Column) -> Column:
    """``shape`` with every ASCII letter and digit replaced by one of its class, taken from the stream; other letters become ASCII ones."""
    dig, low = F.translate(h, "abcdef", "123456"), F.translate(h, "0123456789abcdef", "bcdfghjklmnpqrst")
    at = lambda s, i: F.substr(s, (i % 128) + 1, F.lit(1))
    swap = lambda c, i: (
        F.when(c.between("0", "9"), at(dig, i)).when(c.between("a", "z"), at(low, i)).when(c.between("A", "Z"), F.upper(at(low, i)))
        .when(c.rlike(r"\p{Lu}"), F.upper(at(low, i))).when(c.rlike(r"\p{L}|\p{N}"), at(low, i)).otherwise(c)
    )
    return F.array_join(F.transform(F.split(shape, ""), swap), "")


def _with_check_digit(d: Column) -> Column:
    """The digits with the last one set so that the Luhn sum is a multiple of ten."""
    body = F.reverse(F.substr(d, F.lit(1), F.length(d) - 1))
    each = F.transform(F.split(body, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c > "4", F.lit(9)).otherwise(F.lit(0))).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.concat(F.substr(d, F.lit(1), F.length(d) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _remainder_97(s: Column) -> Column:
    """The remainder by 97 of a string of digits and letters, which count as 10 to 35."""
    step = lambda a, c: F.when(c >= "A", (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + c.cast("int")) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: step(a, c).cast("int"))


def _pick(values: list[str], h: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.conv(F.substring(h, at, 4), 16, 10).cast("int") % len(values) + 1)


def _invented(h: Column, syllables: Column, cyrillic: Column) -> Column:
    """A capitalised word of so many syllables (30 at most) from the stream."""
    of = lambda s: F.transform(F.sequence(F.lit(1), F.least(syllables, F.lit(30))), lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[s])), F.conv(F.substr(h, 4 * i - 3, F.lit(4)), 16, 10).cast("int") % 16 + 1))
    return F.initcap(F.array_join(F.when(cyrillic, of("cyrillic")).otherwise(of("latin")), ""))


def _family_surrogate(family: Column, attempt: Column, key: str) -> Column:
    return _invented(_stream(key, F.lit("family"), family, attempt.cast("string")), attempt + 4, family.rlike(r"\p{IsCyrillic}"))


def _given_names(canon: Column, gender: str) -> Column:
    """The listed names that a person doesn't have, all if none is left."""
    words = F.split(F.substr(canon, F.lit(3), F.length(canon)), " ")
    names = F.when(canon.rlike(r"\p{IsCyrillic}"), F.array(*map(F.lit, GIVEN[gender, "cyrillic"]))).otherwise(F.array(*map(F.lit, GIVEN[gender, "latin"])))
    rest = F.filter(names, lambda x: ~F.array_contains(words, F.lower(x)))
    return F.when(F.size(rest) > 0, rest).otherwise(names)


def _person(canon: Column, family: Column, names: dict[str, Column], attempt: Column, key: str) -> Column:
    """A name of the canonical form's gender and script before the family's surrogate."""
    words = F.split(F.substr(canon, F.lit(3), F.length(canon)), " ")
    given = F.filter(F.slice(words, 1, F.size(words) - 1), lambda w: w != "")
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    of = lambda g, h: F.element_at(names[g], F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % F.size(names[g]) + 1)

    def named(w: Column, i: Column) -> Column:
        tries = F.when(i == 0, attempt).otherwise(F.lit(0))  # the first name tells persons of one family apart
        h = _stream(key, F.lit("given"), w, tries.cast("string"))
        listed = F.when(canon.startswith("m "), of("m", h)).when(canon.startswith("f "), of("f", h)).otherwise(F.when(F.substring(h, 128, 1) < "8", of("m", h)).otherwise(of("f", h)))
        return F.when(tries < LISTED, listed).otherwise(F.concat(listed, F.lit("-"), _invented(F.substr(h, F.lit(9), F.lit(120)), tries - LISTED + 2, cyrillic)))

    return F.concat_ws(" ", F.transform(given, named), family)


def _surrogate(kind: Column, canon: Column, family: Column, names: dict[str, Column], attempt: Column, key: str) -> Column:
    """The canonical form of the replacement."""
    h = _stream(key, kind, canon, attempt.cast("string"))
    plain = _refill(canon, h)
    octets = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda i: (F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string")), ".")
    card = _with_check_digit(F.concat(F.substring(canon, 1, 1), F.substr(plain, F.lit(2), F.length(canon))))
    phone = F.when(
        canon.rlike(r"^1\d{10}$"),
        F.concat(F.lit("1"), F.translate(F.substring(plain, 2, 1), "01", "23"), F.substring(plain, 3, 2), F.translate(F.substring(plain, 5, 1), "01", "45"), F.substring(plain, 6, 6)),
    ).otherwise(F.concat(F.substring(canon, 1, 2), F.substr(plain, F.lit(3), F.length(canon))))
    local = _refill(F.substring_index(canon, "@", 1), h)
    domain = F.substring_index(canon, "@", -1)
    sub = F.substr(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -2)))
    mail = F.concat(local, F.when(attempt >= 8, F.substring(h, 100, 6)).otherwise(""), F.lit("@"), _refill(sub, _stream(key, F.lit("domain"), canon)), F.lit("example."), _pick(["com", "org", "net"], h, 90))
    secret = F.when(canon.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substr(plain, F.lit(5), F.length(canon)))).otherwise(plain)
    account, country = F.substr(plain, F.lit(5), F.length(canon)), F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((F.lit(98) - _remainder_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    return (
        F.when(kind == "email", mail).when(kind == "ipv4", octets).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "person", _person(canon, family, names, attempt, key)).when(kind == "secret", secret).when(kind == "iban", iban).otherwise(plain)
    )


def _fit(kind: Column, e: Column, core: Column) -> Column:
    """The surrogate in the format of one occurrence."""
    chars, n = F.split(e, ""), F.length(e)
    behind = lambda i: F.length(F.regexp_replace(F.substr(e, i + 1, n), r"[^0-9A-Z]", ""))
    # numbers are aligned at the right: a country code may be left out
    filled = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substr(core, F.length(core) - behind(i) + 1, F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(core, ""), lambda c, i: F.when(F.substr(e, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    start = F.length(e) - F.length(_canonical(F.lit("secret"), e))
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"), filled)
        .when(kind == "email", F.when(e == F.lower(e), core).otherwise(cased))
        .when(kind == "secret", F.concat(F.substr(e, F.lit(1), start), core))
        .when(kind == "person", F.concat(F.when(e.rlike(_TITLED), F.regexp_extract(e, r"^(\p{L}+\.? )", 1)).otherwise(""), core))
        .when(kind == "family", F.when((e == F.upper(e)) & (F.length(e) > 1), F.upper(core)).otherwise(core))
        .otherwise(core)
    )


def _distinct_cores(names: DataFrame, core, by: Column) -> DataFrame:
    """``names`` (space, canon and more) with core, the first ``core(attempt)`` that no other name of its space has or is.

    ``by`` is the core's form that is compared with the names.  Every turn computes and deals out only what is open.
    """
    n = partitions(names.sparkSession)
    own = names.select("space", F.col("canon").alias("form")).distinct()
    pending, settled = names, None
    for turn in range(MAX_ATTEMPTS):
        tried = materialize(pending.repartition(n, "space", "canon").withColumn("core", core(F.lit(turn))).withColumn("form", by))
        stays = tried.groupBy("space", "core").agg(F.min("canon").alias("canon"))
        good = tried.join(stays, ["space", "core", "canon"], "left_semi").join(own, ["space", "form"], "left_anti")
        if settled is not None:
            good = good.join(settled.select("space", "core"), ["space", "core"], "left_anti")
        good = materialize(good.select(*names.columns, "core"), compact=True)
        settled = good if settled is None else settled.unionByName(good)
        pending = materialize(pending.join(good, ["space", "canon"], "left_anti"), compact=True)
        if pending.isEmpty():
            return settled
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def with_known_gender(entities: DataFrame) -> DataFrame:
    """Persons without a gender (a title, or a name that stands alone) take that of the same name, or else of the same first given name, elsewhere.

    Of names with both, the more frequent gender counts, the male one of equals; names of neither keep none.  Genders
    are counted with map-side combining and joined by name.
    """
    e = materialize(entities)
    person, gender, name = F.col("kind") == "person", F.substring("canon", 1, 1), F.substr("canon", F.lit(3), F.length("canon"))
    words = F.split(name, " ")
    given = F.when(F.size(words) > 1, words[0])

    def known(by: Column, as_: str, out: str) -> DataFrame:
        seen = e.where(person & gender.isin("m", "f")).groupBy(by.alias(as_)).agg(F.sum(F.when(gender == "m", 1).otherwise(-1)).alias("_n"))
        return seen.where(F.col(as_).isNotNull()).select(as_, F.when(F.col("_n") >= 0, "m").otherwise("f").alias(out))

    open_ = e.where(person & (gender == "u")).select("canon").distinct().withColumns({"_name": name, "_given": given})
    told = open_.join(known(name, "_name", "_g1"), "_name", "left").join(known(given, "_given", "_g2"), "_given", "left")
    told = told.select("canon", F.concat(F.coalesce("_g1", "_g2", F.lit("u")), F.lit(" "), "_name").alias("_canon"))
    return e.join(told, "canon", "left").withColumn("canon", F.when(person, F.coalesce("_canon", "canon")).otherwise(F.col("canon"))).select(*entities.columns)


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, core of every distinct entity (kind, canon), with a core that no other entity of its kind has or is.

    A person's core may be that of a person of another gender, from whom the honorific tells it apart.
    """
    every = materialize(entities.select("kind", "canon").distinct())
    person = F.col("kind") == "person"
    family = F.when(person, _family(F.substr("canon", F.lit(3), F.length("canon")))).when(F.col("kind") == "family", F.col("canon"))
    families = every.select(F.lit("family").alias("space"), family.alias("canon")).where("canon is not null").distinct()
    family_core = _distinct_cores(families, lambda attempt: _family_surrogate(F.col("canon"), attempt, key), F.lower("core"))
    family_core = family_core.select(F.col("canon").alias("family"), F.col("core").alias("family_core"))

    space = F.when(person, F.concat(F.lit("person "), F.substring("canon", 1, 1))).otherwise(F.col("kind"))
    others = every.where("kind != 'family'").withColumn("space", space).withColumn("family", family).join(family_core, "family", "left").drop("family")
    names = {g: F.col(f"{g}_names") for g in "mf"}
    others = materialize(others.withColumns({f"{g}_names": F.when(person, _given_names(F.col("canon"), g)) for g in "mf"}), compact=True)
    settled = _distinct_cores(others, lambda attempt: _surrogate(F.col("kind"), F.col("canon"), F.col("family_core"), names, attempt, key), F.col("core"))
    return settled.select("kind", "canon", "core").unionByName(family_core.select(F.lit("family").alias("kind"), F.col("family").alias("canon"), F.col("family_core").alias("core")))


def redact(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows with surrogates for personal data in ``text_col``; adds n_entities (long)."""
    docs = docs.drop("n_entities")
    ents, listed, pattern = (new_name(docs, c) for c in ("entities", "list", "pattern"))
    text, found = F.col(text_col), F.col(ents)
    marked = docs.withColumn(ents, F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    holds = F.coalesce(F.size(found) > 0, F.lit(False))
    clean = marked.where(~holds).drop(ents).withColumn("n_entities", F.lit(0).cast("long"))
    # whole names and family names of a text's persons are looked for again, where they stand alone; longer ones first
    persons = F.transform(F.filter(found, lambda e: e.rlike(_TITLED)), _bare)
    wanted = F.array_distinct(F.concat(persons, F.transform(persons, _family)))
    families = F.transform(F.array_sort(F.transform(wanted, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    alone = F.concat(F.lit(r"|(?<![\p{L}\p{M}'’-])(?:\Q"), F.array_join(families, r"\E|\Q"), F.lit(r"\E)(?![\p{L}\p{M}])"))
    held = marked.where(holds).withColumn(pattern, F.when(F.size(families) > 0, F.concat(F.lit(ANY), alone)).otherwise(F.lit(ANY)))
    held = held.withColumn(ents, F.when(F.size(families) > 0, F.regexp_extract_all(text, F.col(pattern), F.lit(0))).otherwise(found))
    dirty = materialize(held.withColumn(listed, F.sha2(F.array_join(ents, "\x1f").cast("binary"), 256)))

    each = dirty.select(F.col(listed).alias("list"), F.col(ents).alias("entities")).dropDuplicates(["list"]).select("list", F.posexplode("entities").alias("pos", "e"))
    each = each.withColumn("kind", _type(F.col("e"))).withColumn("canon", _canonical(F.col("kind"), F.col("e")))
    each = with_known_gender(each)
    table = surrogate_table(each, key)
    fitted = each.join(table, ["kind", "canon"]).select("list", "pos", _fit(F.col("kind"), F.col("e"), F.col("core")).alias("s"))
    new = fitted.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("new"))
    again = new_name(dirty, "new")

    parts = F.zip_with(F.split(text, F.col(pattern), -1), F.col(again), lambda g, n: F.concat(g, F.coalesce(n["s"], F.lit(""))))
    done = dirty.join(new.select(F.col("list").alias(listed), F.col("new").alias(again)), listed)
    done = done.withColumn(text_col, F.array_join(parts, "")).withColumn("n_entities", F.size(found).cast("long"))
    return clean.unionByName(done.select(*clean.columns))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return redact(docs, "tallyloom-test-key").select("doc_id", "n_entities", "text")
