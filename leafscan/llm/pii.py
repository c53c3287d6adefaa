"""Personal data replaced by keyed surrogates (operator 6)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import keep, let
from leafscan.session import small

# Titles that give a person's gender, by class, and what an entity looks like.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra", "Signora", "Госпожа", "Κυρία"],
    "n": ["Mx", "Dr", "Prof"],
}
_TITLE = "|".join(sorted((t for titles in TITLES.values() for t in titles), key=lambda t: (-len(t), t)))
_NAME_WORD = r"\p{Lu}[\p{L}'’-]*+"
_CARD = r"\d{4}(?:[ -]?\d{4}){3}"  # the form of a card by itself; other lengths are cards only if valid by Luhn


def _national(sep: str) -> str:
    """At least three groups, 9 to 11 digits in all, between equal separators; not a part of a longer row of digits."""
    around = r"[ .-]" if sep == " " else sep
    return (
        rf"(?<![\p{{L}}\p{{N}}+])(?<!\d{around})(?=(?:\d{sep}?){{9,11}}(?!{sep}?\d))(?:1{sep})?\d{{2,5}}(?:{sep}\d{{2,4}}){{2,4}}"
        rf"(?![\p{{L}}\d]|{around}\d|:\d)"
    )


# National phone numbers: groups; area code, blank and groups with hyphens; 0, area code and one long group.
_NATIONAL = [_national(r"-"), _national(r"\."), _national(" ")] + [
    r"(?<![\p{L}\p{N}+])(?<!\d[ .-])(?=(?:\d[ -]?){9,11}(?![ -]?\d))(?:1[ -])?\d{2,5} \d{2,4}(?:-\d{2,4}){1,2}(?![\p{L}\d]|[ .-]\d|:\d)",
    r"(?<![\p{L}\p{N}+])(?<!\d[ ./-])(?=(?:\d[ /-]?){9,11}(?![ /-]?\d))0\d{1,4}[ /-]\d{5,8}(?![\p{L}\d]|[ ./-]\d|:\d)",
]
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?"
    r"|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\p{L}\p{N}:])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\d])(?:(?<!\d[.,])\d{13,19}(?![.,]\d)|\d{4}([ -])\d{6}\1\d{4,5}(?![ -]?\d)|\d{4}([ -])\d{4}\2\d{4}\2(?:\d|\d{4}\2\d{1,3})(?![ -]?\d)"
    rf"|{_CARD})(?![\p{{L}}\d])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|" + "|".join(_NATIONAL),
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME_WORD}(?: {_NAME_WORD})?",
}
DRAWS = 20  # a number grows, and an octet changes its length, only if so many draws found no free one
COUNTRY = r"[17]|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d"  # country codes: no one begins another
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = rf"[@0-9]|{_TITLE}"  # quick test: a text without this has no entity
KINDS = ["email", "iban", "ip6", "ip", "ssn", "card", "phone", "given", "surname"]
HOT_SHARE = 2_000  # a text is hot if more than one of so many rows holds it
SALTS = 16  # parts over which the rows of a hot text are dealt
WORDS = r"[\p{L}'’-]+|[^\p{L}'’-]+"
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "di", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "pa", "pe", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "ti", "to", "va", "ve"],
    "cyrillic": ["ба", "бе", "ва", "ве", "га", "да", "де", "ди", "за", "ка", "ко", "ла", "ле", "ли", "ма", "ме", "ми", "на", "не", "ни", "ра", "ре", "ро", "са", "та", "те"],
    "greek": ["βα", "γα", "δε", "ζα", "θε", "κα", "κο", "λα", "λε", "μα", "με", "νι", "νο", "πα", "πε", "ρα", "ρο", "σα", "τα", "τε", "φα", "χα"],
}
ENDINGS = {  # by script: masculine, feminine and other given names, and surnames
    "latin": {"m": "n", "f": "ia", "n": "y", "": "r"},
    "cyrillic": {"m": "н", "f": "я", "n": "и", "": "к"},
    "greek": {"m": "ς", "f": "α", "n": "ι", "": "ου"},
}
LETTERS = {  # lower-case letters by range of their code points
    (0x61, 0x7A): "abcdefghijklmnopqrstuvwxyz",
    (0xDF, 0x24F): "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß",
    (0x3AC, 0x3CE): "αβγδεζηθικλμνξοπρστυφχψω",
    (0x430, 0x45F): "абвгдежзийклмнопрстуфхцчшщыэюя",
}


# --- detection -------------------------------------------------------------------


def mentions(body: Column) -> Column:
    """Texts of all entities, leftmost and not overlapping; empty without any."""
    return F.when(body.rlike(HINT), F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(value: Column) -> Column:
    order = ["email", "name", "iban", "ip6", "ip", "ssn", "card"]
    tests = [value.rlike(rf"^(?:{PATTERNS[k]})$") for k in order]
    return reduce(lambda c, kt: c.when(kt[1], kt[0]), list(zip(order, tests, strict=True))[1:], F.when(tests[0], order[0])).otherwise("phone")


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def gender_of(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\. *$| +$", "")
    return F.when(bare.isin(TITLES["m"]), "m").when(bare.isin(TITLES["f"]), "f").otherwise("")


def first_digits(value: Column) -> Column:
    """Country code of a phone number: up to a separator, or else by the public numbering plan; 0 of a national one."""
    split = F.regexp_extract(value, r"^\+(\d{1,3})[ .(-]", 1)
    planned = F.regexp_extract(value, rf"^\+({COUNTRY})", 1)
    return F.when(split != "", split).when(planned != "", planned).otherwise(F.regexp_extract(value, r"^\(?(0)", 1))


def parts_of(value: Column, kind: Column) -> Column:
    """A mention as parts: literal text (kind null), or an entity with its class and its canonical form.

    ``code`` is what the mention tells of the first digits of a phone number, or of the gender of a given name; it is
    no part of the entity.
    Digits in the form of a card of other than sixteen digits in fours are one only if valid by Luhn.
    """

    def part(shown: Column, kind: Column, cls: Column, canon: Column, code: Column = F.lit("")) -> Column:
        return F.struct(shown.alias("shown"), kind.alias("kind"), cls.alias("cls"), canon.alias("canon"), code.alias("code"))

    null = F.lit(None).cast("string")
    title = F.regexp_extract(value, rf"^(?:{_TITLE})\.? ", 0)
    rest = F.split(F.substring(value, F.length(title) + 1, F.length(value)), " ")
    first, last = F.get(rest, F.lit(0)), F.get(rest, F.size(rest) - 1)
    surname = part(last, F.lit("surname"), script_of(last), F.lower(last))
    given = part(first, F.lit("given"), script_of(first), F.lower(first), gender_of(title))
    literal = part(title, null, null, null)
    blank = part(F.lit(" "), null, null, null)
    name = F.when(F.size(rest) == 1, F.array(literal, surname)).otherwise(F.array(literal, given, blank, surname))
    numeric = F.array(part(value, kind, F.lit(""), digits(value), F.when(kind == "phone", first_digits(value)).otherwise("")))
    plain = F.array(part(value, kind, F.lit(""), F.lower(value)))
    head = F.regexp_extract(value, rf"^{_CARD}(?!\d)", 0)
    rest = F.substring(value, F.length(head) + 1, F.length(value))
    begun = F.array(part(head, kind, F.lit(""), digits(head)), part(rest, null, null, null))
    valid = luhn_sum(digits(value)) % 10 == 0
    card = F.when((rest == "") | valid, numeric).when(head != "", begun).otherwise(F.array(part(value, null, null, null)))
    spaceless = F.array(part(value, kind, F.lit(""), F.replace(value, F.lit(" "), F.lit(""))))
    return F.when(kind == "name", name).when(kind == "card", card).when(kind.isin("email", "ip", "ip6"), plain).when(kind == "iban", spaceless).otherwise(numeric)


# --- surrogates ------------------------------------------------------------------


def byte(stream: Column, i: Column) -> Column:
    """The i-th keyed byte, 0 to 255."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(text: str, b: Column) -> Column:
    return F.substring(F.lit(text), F.pmod(b, F.lit(len(text))) + 1, F.lit(1))


def same_class(text: Column, stream: Column) -> Column:
    """Every letter and digit replaced by one of its script and class; other signs stay."""

    def other(c: Column, i: Column) -> Column:
        b = byte(stream, i)
        out = F.when(c.rlike("[0-9]"), pick("0123456789", b))
        for (low, high), letters in LETTERS.items():
            out = out.when((c >= chr(low)) & (c <= chr(high)) & c.rlike(r"\p{L}"), pick(letters, b))
        out = out.when(c.rlike(r"[\p{IsHan}]"), F.decode(F.unhex(F.concat(F.lit("4E"), F.lpad(F.hex(b), 2, "0"))), "UTF-16BE"))
        return out.when(c.rlike(r"[\p{L}\p{N}]"), pick(LETTERS[(0x61, 0x7A)], b)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), other), "")


def luhn_sum(number: Column) -> Column:
    """Luhn sum of a string of digits."""

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + F.pmod(F.length(number) - 1 - i, F.lit(2)))
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(number, ""), weighed), F.lit(0), lambda a, x: a + x)


def new_digits(canon: Column, fixed: Column, stream: Column) -> Column:
    """As many digits, the first ``fixed`` as they were."""
    return F.array_join(
        F.transform(F.split(canon, ""), lambda c, i: F.when(i < fixed, c).otherwise(pick("0123456789", byte(stream, i)))), ""
    )


def new_card(canon: Column, stream: Column) -> Column:
    """As many digits with the first one kept; valid by Luhn if the original is."""
    head = F.substring(new_digits(canon, F.lit(1), stream), F.lit(1), F.length(canon) - 1)
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10))
    free = pick("0123456789", byte(stream, F.lit(40)))
    return F.concat(head, F.when(luhn_sum(canon) % 10 == 0, check.cast("string")).otherwise(free))


def new_ip(canon: Column, stream: Column, attempt: int) -> Column:
    """Octets of the same length; of any length once ``DRAWS`` draws found no free address."""

    def octet(o: Column, i: Column) -> Column:
        b = byte(stream, i)
        if attempt > DRAWS:
            return (b % 254 + 1).cast("string")
        n = F.when(F.length(o) == 1, b % 9 + 1).when(F.length(o) == 2, b % 90 + 10).otherwise(b % 155 + 100)
        return n.cast("string")

    return F.array_join(F.transform(F.split(canon, r"\."), octet), ".")


def new_ip6(canon: Column, stream: Column) -> Column:
    """As many hexadecimal digits in each group."""
    return F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(pick("0123456789abcdef", byte(stream, i)))), "")


def iban_rest(account: Column) -> Column:
    """Remainder of an account number by 97, letters as two digits and the first four signs at the end; 1 if it is valid."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def new_iban(canon: Column, stream: Column) -> Column:
    """The country stays, letters and digits keep their places; valid if the original is."""
    own = F.substring(canon, F.lit(5), F.length(canon))
    made = F.transform(F.split(own, ""), lambda c, i: F.when(c.rlike(r"\d"), pick("0123456789", byte(stream, i))).otherwise(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", byte(stream, i))))
    country = F.substring(canon, 1, 2)

    def checked(rest: Column) -> Column:
        check = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
        free = F.concat(pick("0123456789", byte(stream, F.lit(50))), pick("0123456789", byte(stream, F.lit(51))))
        return F.concat(country, F.when(iban_rest(canon) == 1, check).otherwise(free), rest)

    return let(F.array_join(made, ""), checked)


def new_name(script: Column, gender: Column, stream: Column, attempt: int) -> Column:
    out = None
    for name, syllables in SYLLABLES.items():
        listed = F.array(*[F.lit(s) for s in syllables])
        many = F.sequence(F.lit(0), F.lit(2 + attempt))
        stem = F.array_join(F.transform(many, syllable(listed, stream)), "")
        ending = reduce(lambda c, ge: c.when(gender == ge[0], ge[1]), list(ENDINGS[name].items())[1:], F.when(gender == "m", ENDINGS[name]["m"]))
        made = F.concat(stem, ending)
        out = F.when(script == name, made) if out is None else out.when(script == name, made)
    return out


def syllable(listed: Column, stream: Column):
    return lambda i: F.get(listed, F.pmod(byte(stream, i), F.size(listed)))


def new_domain(canon: Column, stream: Column, attempt: int) -> Column:
    """Labels of the same classes, then ``example`` under the old ending."""
    labels = F.split(canon, r"\.")
    own = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), ".")
    more = F.substring(same_class(F.lit("a0" * 8), F.reverse(stream)), 1, max(0, attempt - 1))  # longer only if short forms run out
    return F.concat(same_class(own, stream), more, F.lit(".example."), F.get(labels, F.size(labels) - 1))


def new_email(canon: Column, domain: Column, stream: Column, attempt: int) -> Column:
    """Local part of the same classes at the surrogate of the domain."""
    more = F.substring(same_class(F.lit("a0" * 8), F.reverse(stream)), 1, max(0, attempt - 1))
    return F.concat(same_class(F.substring_index(canon, "@", 1), stream), more, F.lit("@"), domain)


def surrogate(attempt: int, key: str) -> Column:
    """Canonical surrogate of an entity, a keyed function of its kind, class, canonical form and of the attempt.

    ``code`` holds what stays or is decided already: first digits of a phone
    number, the gender of a given name, the surrogate domain of an email.
    """
    kind, cls, canon = F.col("kind"), F.col("cls"), F.col("canon")

    def keyed(*parts: Column) -> Column:
        first = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, F.lit(str(attempt))), 256)
        return F.concat(first, F.sha2(F.concat(F.lit(key), first), 256))

    longer = F.lit("0" * max(0, attempt - DRAWS))

    def made(stream: Column) -> Column:
        return (
            F.when(kind == "email", new_email(canon, F.col("code"), stream, attempt))
            .when(kind == "domain", new_domain(canon, stream, attempt))
            .when(kind == "iban", new_iban(canon, stream))
            .when(kind == "ip6", new_ip6(canon, stream))
            .when(kind == "ip", new_ip(canon, stream, attempt))
            .when(kind == "card", new_card(canon, stream))
            .when(kind.isin("phone", "ssn"), F.concat(new_digits(canon, F.length("code"), stream), longer))
            .otherwise(new_name(cls, F.when(kind == "surname", "").when(F.col("code") == "", "n").otherwise(F.col("code")), stream, attempt))
        )

    return let(keyed(kind, cls, canon), made)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind, cls, canon, surrogate``: distinct surrogates of a kind, none equal to an entity that occurs.

    Draws are repeated for the entities whose draw is taken: by an entity of
    the corpus, by an earlier round, or in the same round by an entity that
    comes first in order. So are emails that would keep their local part.
    """
    pending, done = entities, None
    for attempt in count():
        drawn = pending.withColumn("surrogate", surrogate(attempt, key))
        real = entities.select("kind", F.col("canon").alias("surrogate")).distinct()
        drawn = drawn.join(real, ["kind", "surrogate"], "left_anti")
        kept = (F.col("kind") == "email") & (F.substring_index("surrogate", "@", 1) == F.substring_index("canon", "@", 1))
        drawn = drawn.filter(~kept)
        if done is not None:
            drawn = drawn.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("cls", "canon")).alias("own"))
        won = keep(first.select("kind", "own.cls", "own.canon", "surrogate"), "pii-round")
        done = won if done is None else done.unionByName(won)
        pending = keep(pending.join(won, ["kind", "cls", "canon"], "left_anti"), "pii-pending")
        if pending.isEmpty():
            return done
    return done


def rendered(shown: Column, kind: Column, made: Column) -> Column:
    """The surrogate in the form of the mention: its separators, or its case."""
    nth = F.transform(
        F.split(shown, ""),
        lambda c, i: F.when(c.rlike(r"\d"), F.substring(made, F.length(digits(F.substring(shown, F.lit(1), i + 1))), F.lit(1))).otherwise(c),
    )
    numeric = F.concat(F.array_join(nth, ""), F.substring(made, F.length(digits(shown)) + 1, F.length(made)))
    upper = (F.upper(shown) == shown) & (F.length(shown) > 1)
    spaced = F.transform(F.split(shown, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(made, F.length(F.replace(F.substring(shown, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1))))
    word = F.when(upper, F.upper(made)).otherwise(F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, F.lit(2), F.length(made))))
    mail = F.when(F.upper(shown) == shown, F.upper(made)).otherwise(made)
    return F.when(kind.isin("given", "surname"), word).when(kind.isin("email", "ip", "ip6"), mail).when(kind == "iban", F.array_join(spaced, "")).otherwise(numeric)


def bare_names(gap: Column, names: Column) -> Column:
    """Words of the text between mentions as structs ``shown, new``; ``new`` is NULL but for capitalised surnames of ``names``, a map by canonical form."""

    def word(w: Column) -> Column:
        ending = F.regexp_extract(w, "['’]s$", 0)
        stem = F.substring(w, F.lit(1), F.length(w) - F.length(ending))
        made = F.when(stem.rlike(r"^\p{Lu}"), F.try_element_at(names, F.lower(stem)))
        return F.struct(w.alias("shown"), F.concat(rendered(stem, F.lit("surname"), made), ending).alias("new"))

    return F.transform(F.regexp_extract_all(gap, F.lit(WORDS), F.lit(0)), word)


def replace_pii(docs: DataFrame, key: str, text: str = "text", order: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, text`` with surrogates and a count per kind of ``KINDS``, such as ``n_email``.

    Emails, internet addresses (IPv4, IPv6), bank accounts (IBAN), US social
    security numbers, cards (16 digits in fours, or 13 to 19 digits valid by
    Luhn), phone numbers (with a country code or a bracketed area code, or 9 to
    11 digits in groups) and names after a title are replaced; so is a surname
    wherever it stands as a capitalised word of the same text. The same entity
    gets the same surrogate everywhere, also if written with other separators
    or case; the words of a name are entities of their own, so a surname alone
    agrees with the full name, and a given name is one entity under any title.
    Domains are entities too: different ones stay different. Surrogates keep
    number of digits, country code, Luhn and IBAN validity, octet length,
    letter classes, script, case and the gender that titles tell, the most
    frequent one if they differ; octets have another length if no address is
    left. Null stays null; texts without entities stay as they are; repeated
    rows each get a row, an empty table none; extra columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(order).alias("doc_id"), F.col(text).alias("body"), F.sha2(body, 256).alias("key"))
    found = rows.filter(F.col("body").rlike(HINT)).select("key", F.posexplode(mentions(F.col("body"))).alias("i", "value")).distinct()
    kinds = found.select("key", "i", "value", kind_of(F.col("value")).alias("kind"))
    parts = kinds.select("key", "i", F.posexplode(parts_of(F.col("value"), F.col("kind"))).alias("j", "p")).select("key", "i", "j", "p.*")
    parts = keep(parts, "pii-parts")
    told = parts.filter("kind is not null").groupBy("kind", "cls", "canon", "code").agg(F.count("*").alias("n"))
    best = F.max(F.struct((F.col("code") != "").alias("any"), "n", "code"))["code"]  # of all mentions of a number or name, the most frequent
    entities = keep(told.groupBy("kind", "cls", "canon").agg(best.alias("code")), "pii-entities")
    emails = F.col("kind") == "email"
    domain = F.substring_index("canon", "@", -1)
    domains = entities.filter(emails).select(F.lit("domain").alias("kind"), F.lit("").alias("cls"), domain.alias("canon"), F.lit("").alias("code")).distinct()
    domains = assign(domains, key).select(F.col("canon").alias("domain"), F.col("surrogate").alias("domain_to"))
    entities = entities.withColumn("domain", F.when(emails, domain)).join(domains, "domain", "left")
    entities = keep(entities.select("kind", "cls", "canon", F.when(emails, F.col("domain_to")).otherwise(F.col("code")).alias("code")), "pii-named")
    mapping = assign(entities, key)
    shown = parts.join(mapping, ["kind", "cls", "canon"], "left").select(
        "key", "i", "j", "kind", "canon", "surrogate", F.coalesce(rendered(F.col("shown"), F.col("kind"), F.col("surrogate")), F.col("shown")).alias("new")
    )
    counts = [F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS]
    names = F.map_from_entries(F.collect_set(F.when(F.col("kind") == "surname", F.struct("canon", "surrogate"))))
    edits = shown.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "j", "new"))).alias("edits"), names.alias("names"), *counts)

    def rebuilt(gaps: Column) -> Column:
        put = F.transform("edits", lambda e: F.concat(F.when(e["j"] == 0, F.get(gaps, e["i"])).otherwise(""), e["new"]))
        return F.concat(F.array_join(put, ""), F.get(gaps, F.size(gaps) - 1))

    def with_names(gaps: Column) -> Column:
        """Text and the number of surnames that stand by themselves."""
        many = F.size("names") > 0
        words = F.when(many, F.transform(gaps, lambda g: bare_names(g, F.col("names"))))
        filled = lambda ws: F.transform(ws, lambda g: F.array_join(F.transform(g, lambda w: F.coalesce(w["new"], w["shown"])), ""))
        number = lambda ws: F.aggregate(ws, F.lit(0).cast("long"), lambda n, g: n + F.size(F.filter(g, lambda w: w["new"].isNotNull())))
        plain = F.struct(rebuilt(gaps).alias("text"), F.lit(0).cast("long").alias("more"))
        return F.when(many, let(words, lambda ws: F.struct(let(filled(ws), rebuilt).alias("text"), number(ws).alias("more")))).otherwise(plain)

    whole = salted_join(rows, edits)
    new = F.when(F.col("edits").isNotNull(), let(F.split(F.col("body"), ANY, -1), with_names))
    made = whole.select("doc_id", "body", new.alias("made"), *[f"n_{k}" for k in KINDS])
    number = {k: F.coalesce(f"n_{k}", F.lit(0).cast("long")) for k in KINDS}
    number["surname"] = number["surname"] + F.coalesce("made.more", F.lit(0).cast("long"))
    return made.select("doc_id", F.coalesce("made.text", "body").alias("text"), *[number[k].alias(f"n_{k}") for k in KINDS])


def salted_join(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Left join by ``key``; the rows of a text that many share are dealt over several tasks, to each of which its edits go.

    Texts are counted with partial aggregates; at most ``HOT_SHARE`` are hot.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("copies"))
    total = rows.count()
    hot = keep(counts.filter(F.col("copies") * HOT_SHARE > total).select("key", F.lit(True).alias("hot")), "pii-hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(small(hot), "key", "left").select("doc_id", "body", "key", salt.alias("salt"))
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = edits.join(small(hot), "key", "left").withColumn("salt", F.explode(every)).drop("hot")
    return dealt.join(spread, ["key", "salt"], "left")
