"""Personal data replaced by keyed, type-consistent surrogates.

Detected kinds: e-mail addresses, telephone numbers, payment cards, IPv4
addresses, social-security numbers and names after a form of address.  An
entity is (kind, canonical value); wherever it occurs it gets the same
surrogate, made from a keyed hash of it, in the format of the place: separators,
capitals, digit counts, a country prefix, the validity of a card's check digit,
the gender of the form of address and the script of a name stay.

Distinct entities keep distinct surrogates: surrogates that meet, or that equal
an entity of the corpus, are drawn again with the next attempt number until none
do.  The check runs over all distinct entities with a shuffle of their canonical
forms; an entity held by a third of all rows is reduced inside its partition
first.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage, lookup_by_run, text_of

FEMALE = "Mrs|MRS|Ms|MS|Miss|Frau|FRAU|Mme|Madame|Sra|Señora|Госпожа|Κυρία"
MALE = "Mr|MR|Herr|HERR|Monsieur|Sr|Señor|Господин|Κύριος"
#: telephone numbers without + or brackets: 3-3-4; a trunk zero (but no date); nine digits from 6-9
NATIONAL = (r"(?=[0-9])(?<![\p{L}\p{N}+])(?<![0-9][.,:/-])(?:"
            r"(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
            r"|0[0-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4}[ ./-][0-9]{5,8}(?:-[0-9]{1,4})?|0[0-9][ /-][0-9]{6,8}"
            r"|(?!0[0-9][./ -][0-9]{2}[./ -](?:19|20)[0-9]{2}(?![0-9]))(?=(?:[ ./-]?[0-9]){9})"
            r"0[0-9]{1,4}(?:[ ./-][0-9]{2,4}){1,3}[ ./-][0-9]{2,8}"
            r"|[6-9][0-9]{2}[ -][0-9]{3}[ -][0-9]{3}(?! [0-9])|[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}"
            r"|[89][0-9][ .-][0-9]{3}(?:[ .-][0-9]{2}){2})(?![0-9])")
#: kind -> pattern, tried in this order at every position
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"
            r"|(?<![0-9])(?:[0-9]{4}[ -](?:[0-9]{6}[ -][0-9]{4,5}|[0-9]{5}[ -][0-9]{6})|[0-9]{6}[ -][0-9]{13})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
             r"|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|" + NATIONAL,
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{FEMALE}|{MALE})\.? \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?",
}
KINDS = list(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: consonants and vowels of made-up names, by script
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστ", "αεηιο")}
ENDINGS = {"latin": ("a", "n"), "cyrillic": ("а", "н"), "greek": ("α", "ν")}


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256)


def _byte(digest: Column, i: Column | int) -> Column:
    at = F.lit(2 * i + 1) if isinstance(i, int) else 2 * i + 1
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def _digits(digest: Column, n: Column) -> Column:
    """n digits (36 at most), 0-9 alike."""
    part = lambda at: F.lpad((F.conv(F.substring(digest, at, 15), 16, 10).cast("long") % 10 ** 12).cast("string"), 12, "0")
    return F.substring(F.concat(part(1), part(16), part(31)), F.lit(1), n)


def _chars(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.substring(v, i, F.lit(1)))


def _only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def canonical(kind: Column, value: Column) -> Column:
    """What makes two occurrences the same entity: case, separators, a country
    prefix before ten digits and the form of address do not."""
    digits = _only_digits(value)
    name = F.regexp_replace(value, rf"^(?:{FEMALE}|{MALE})\.? ", "")
    female = value.rlike(rf"^(?:{FEMALE})\.? ")
    return (F.when(kind == "phone", F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits))
            .when(kind.isin("card", "ssn"), digits).when(kind == "email", F.lower(value))
            .when(kind == "name", F.concat(F.when(female, "f ").otherwise("m "), F.lower(name))).otherwise(value))


def _luhn(digits: Column) -> Column:
    """Check sum of digits that lack their check digit."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def _card(canon: Column, digest: Column) -> Column:
    n = F.length(canon)
    body = F.concat(F.substring(canon, 1, 1), _digits(digest, n - 2))
    check = lambda b: (10 - _luhn(b)) % 10
    valid = check(F.substring(canon, F.lit(1), n - 1)) == F.substring(canon, -1, 1).cast("int")
    return F.concat(body, ((check(body) + F.when(valid, 0).otherwise(1)) % 10).cast("string"))


def _email(key: str, canon: Column, digest: Column, attempt: Column) -> Column:
    """Letters become letters, digits digits, signs stay; a short local part or a
    further attempt gets more letters; a domain has one surrogate of its own."""
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    letter = lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(digest, i % 32) % 26 + 1, F.lit(1))
    chars = F.transform(_chars(local), lambda c, i: F.when(c.rlike(r"\p{L}"), letter(i)).when(
        c.rlike(r"\p{N}"), (_byte(digest, i % 32) % 10).cast("string")).otherwise(c))
    more = F.transform(F.sequence(F.lit(0), F.greatest(6 - F.length(local), F.lit(0)) + 2 * attempt), lambda i: letter(31 - i % 32))
    host = F.concat(F.lit("h"), F.substring(_digest(key, F.lit("domain"), domain), 1, 12), F.lit(".example"))
    return F.concat(F.array_join(chars, ""), F.array_join(F.slice(more, F.lit(2), F.size(more)), ""), F.lit("@"), host)


def _made_up(key: str, role: str, token: Column, extra: Column, female: Column | None) -> Column:
    """A pronounceable word in the script of the token."""
    digest = _digest(key, F.lit(role), token, extra)

    def word(script: str) -> Column:
        c, v = SYLLABLES[script]
        parts = F.transform(F.sequence(F.lit(0), F.lit(2 if female is not None else 3)), lambda i: F.concat(
            F.substring(F.lit(c), _byte(digest, i) % len(c) + 1, F.lit(1)),
            F.substring(F.lit(v), _byte(digest, i + 8) % len(v) + 1, F.lit(1))))
        end = F.lit("") if female is None else F.when(female, ENDINGS[script][0]).otherwise(ENDINGS[script][1])
        return F.concat(F.array_join(parts, ""), end)

    return F.when(token.rlike(r"\p{IsCyrillic}"), word("cyrillic")).when(token.rlike(r"\p{IsGreek}"), word("greek")).otherwise(word("latin"))


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Surrogate of an entity in canonical form."""
    digest = _digest(key, kind, canon, attempt)
    ip = F.concat_ws(".", *[(1 + _byte(digest, 0) % 223).cast("string"), *[_byte(digest, i).cast("string") for i in (1, 2, 3)]])
    n = F.length(canon)
    # a trunk zero stays, as does the first of nine digits, which tells such a number
    lead = (F.when(canon.startswith("0") & (n >= 8), F.concat(F.lit("0"), (1 + _byte(digest, 31) % 9).cast("string")))
            .when(n == 9, F.substring(canon, 1, 1)).otherwise((2 + _byte(digest, 31) % 8).cast("string")))
    phone = F.concat(lead, _digits(digest, n - F.length(lead)))
    female, words = canon.startswith("f "), F.split(F.substring(canon, F.lit(3), F.length(canon)), " ")
    family = _made_up(key, "family", F.element_at(words, -1), F.when(attempt > 0, F.concat(canon, attempt.cast("string"))).otherwise(""), None)
    given = _made_up(key, "given", F.element_at(words, 1), F.lit(""), female)
    name = F.concat(F.substring(canon, 1, 2), F.when(F.size(words) > 1, F.concat(given, F.lit(" "), family)).otherwise(family))
    return (F.when(kind == "email", _email(key, canon, digest, attempt)).when(kind == "ip", ip).when(kind == "card", _card(canon, digest))
            .when(kind == "ssn", _digits(digest, F.length(canon))).when(kind == "phone", phone).otherwise(name))


def in_format(kind: Column, value: Column, new: Column) -> Column:
    """A canonical surrogate in the format of one occurrence."""
    count = F.length(_only_digits(value))
    kept = count - F.length(new)
    places = F.transform(_chars(value), lambda c, i: F.when(~c.rlike("[0-9]"), c).otherwise(_place(value, new, kept, c, i)))
    title = F.regexp_extract(value, rf"^((?:{FEMALE}|{MALE})\.? )", 1)
    plain = F.substring(new, F.lit(3), F.length(new))
    name = F.concat(title, F.when(F.upper(value) == value, F.upper(plain)).otherwise(F.initcap(plain)))
    mail = F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(new)).otherwise(new)
    return (F.when(kind.isin("card", "ssn", "phone"), F.array_join(places, "")).when(kind == "name", name)
            .when(kind == "email", mail).otherwise(new))


def _place(value: Column, new: Column, kept: Column, c: Column, i: Column) -> Column:
    nth = F.length(_only_digits(F.substring(value, F.lit(1), i + 1)))             # this digit's number from the left
    return F.when(nth <= kept, c).otherwise(F.substring(new, nth - kept, F.lit(1)))


def find_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(run, uid, doc_id, gaps, found) for every row, written once: the text
    between the entities, and each entity's kind, value and canonical form."""
    t = text_of(text_col)
    base = docs.select(F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("uid"),
                       F.col(id_col).alias("doc_id"), F.split(t, ANY, -1).alias("gaps"),
                       F.regexp_extract_all(t, F.lit(ANY), F.lit(0)).alias("values"))

    def one(v: Column, i: Column) -> Column:
        kind = F.when(v.rlike("@"), "email")
        for k in KINDS[1:-1]:
            kind = kind.when(v.rlike(f"^(?:{PATTERNS[k]})$"), k)
        kind = kind.otherwise("name")
        return F.struct(i.alias("i"), kind.alias("kind"), v.alias("value"))

    base = base.withColumn("found", F.transform("values", one)).drop("values")
    base = base.withColumn("found", F.transform("found", lambda x: F.struct(
        x["i"].alias("i"), x["kind"].alias("kind"), x["value"].alias("value"), canonical(x["kind"], x["value"]).alias("canon"))))
    return cut_lineage(base)


def attempts(entities: DataFrame, key: str, max_rounds: int = 50) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate meets another
    one's or a real entity; all others take attempt 0.

    A surrogate wanted by several goes to the smallest canonical form; the rest
    draw again against everything settled so far."""
    entities = cut_lineage(entities.select("kind", "canon").distinct())
    real = entities.select("kind", F.col("canon").alias("new"))
    wanted = cut_lineage(entities.withColumn("attempt", F.lit(0)).withColumn(
        "new", surrogate(key, F.col("kind"), F.col("canon"), F.lit(0))))
    settled = None
    for _ in range(max_rounds):
        first = wanted.groupBy("kind", "new").agg(F.min("canon").alias("canon")).join(real, ["kind", "new"], "left_anti")
        if settled is not None:
            first = first.join(settled.select("kind", "new"), ["kind", "new"], "left_anti")
        won = wanted.join(first, ["kind", "new", "canon"], "left_semi")
        lost = cut_lineage(wanted.join(first, ["kind", "new", "canon"], "left_anti"))
        settled = won if settled is None else cut_lineage(settled.unionByName(won))
        if lost.limit(1).count() == 0:
            return settled.where("attempt > 0").select("kind", "canon", "attempt")
        wanted = cut_lineage(lost.drop("new").withColumn("attempt", F.col("attempt") + 1).withColumn(
            "new", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))))
    raise RuntimeError(f"surrogates still meet after {max_rounds} attempts")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, entities (kind:start:end in code
    points of the original, comma-joined) for every row.

    A null text becomes empty; texts without an entity come back unchanged."""
    rows = find_entities(docs, id_col, text_col)
    each = rows.select("run", "uid", F.explode("found").alias("e")).select("run", "uid", "e.*")
    again = attempts(each, key)
    each = lookup_by_run(each, ["kind", "canon"], again).withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    each = each.withColumn("new", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
    each = each.select("uid", F.struct("i", in_format(F.col("kind"), F.col("value"), F.col("new")).alias("new")).alias("e"))
    new = each.groupBy("uid").agg(F.array_sort(F.collect_list("e")).alias("new"))
    held = rows.where(F.size("found") > 0).join(new, "uid")
    told = F.aggregate(
        F.arrays_zip(F.slice("gaps", F.lit(1), F.size("found")).alias("gap"), F.col("found").alias("e")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["e"]["value"])).alias("at"),
            F.concat(acc["out"], F.when(acc["out"] != "", ",").otherwise(""), F.concat_ws(
                ":", x["e"]["kind"], (acc["at"] + F.length(x["gap"])).cast("string"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["e"]["value"])).cast("string"))).alias("out")))["out"]
    text = F.array_join(F.zip_with("gaps", F.array_append(F.transform("new", lambda e: e["new"]), F.lit("")),
                                   lambda g, s: F.concat(g, s)), "")
    held = held.select("doc_id", text.alias("text"), F.size("found").cast("long").alias("n_entities"), told.alias("entities"))
    free = rows.where(F.size("found") == 0).select("doc_id", F.element_at("gaps", 1).alias("text"),
                                                   F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entities"))
    return held.unionByName(free)
