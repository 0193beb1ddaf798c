"""Personal data replaced by surrogates, in Spark's own expressions.

An entity is replaced by one that a key and a hash choose, of its own type: an e-mail address by one whose local part has the same shape and
capitals, a card number of the same issuer digit and grouping, valid by Luhn if the original was, a telephone number of the same country
and punctuation, an IPv4 address of the same kind, a social security number, an IBAN of the same country and spacing, with right check
digits if the original's were, and after an honorific a name of the same gender and script. Given and family names are entities of their
own, so "Mr Adam Smith" and "Mr Smith" keep a family name in common, and in a text that names Smith with an honorific, so does
every Smith without one. Equal entities get equal surrogates in all documents, however they are punctuated.

Distinctness: the different entities of the corpus are listed once (mentions only, not texts, are shuffled). Where two get one
surrogate, or one gets another's real value, all but the first draw again until none clashes; with the draws, the space of names and
addresses grows. Those that drew again are few; they are looked up as a literal map up to MAP_ROWS of them and through a join by
document above that.

Formats: telephone numbers with the area in brackets, after + in groups or in one run, or as 555-123-4567; IBANs in one run or in groups of
four; cards of 16 digits; names of a capital and small letters, one or two after an honorific. Others are left.

Rows: a null text stays null. Texts without entities are unchanged, control characters stay everywhere. Repeated rows get equal results.
Columns other than the text pass through whatever their names. Among entities that clash, the least keeps its draw. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, column, free_name
from .spans import CLOSE, OPEN

MAP_ROWS = 500

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
IPV4 = r"(?<![0-9A-Za-z])(?<![0-9]\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9A-Za-z])(?!\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{16})(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|\+[0-9]{1,3}(?:(?:[ .-][0-9]{2,4}){2,4}|(?:[ .-][0-9]{1,4}){4,6})(?![0-9A-Za-z])|\+[0-9]{8,15}(?![0-9A-Za-z])|(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9A-Za-z-])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z]{0,4}[0-9][0-9A-Z]{9,29}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])"
MALE, FEMALE = ("Mr", "Herr", "Señor", "Monsieur", "Господин"), ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа")
_WORD = r"(?:\p{Lu}\p{Ll}+|\p{Lu}(?=['-]))(?:['-]\p{Lu}?\p{Ll}{2,})*"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join((*FEMALE, *MALE))})\.? {_WORD}(?: {_WORD})?"
ENTITY = "|".join((EMAIL, IPV4, IBAN, CARD, PHONE, SSN, NAME))
HINT = r"[0-9]{3}|@|[0-9]\.[0-9]|\+[0-9]|[A-Z]{2}[0-9]{2}"

# Given names and syllables of family names by script.
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul"),
    ("latin", "f"): ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("greek", "m"): ("Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Λεωνίδας", "Μάριος", "Νίκος", "Ορέστης", "Παύλος", "Σπύρος", "Στέφανος", "Τάσος", "Φώτης"),
    ("greek", "f"): ("Αγγελική", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηλέκτρα", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νεφέλη", "Ξένια", "Σοφία", "Φωτεινή"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Софья", "Юлия"),
}
SYLLABLES = {
    "latin": ("ba", "cor", "del", "fen", "gar", "hol", "jan", "kel", "lin", "mor", "nor", "per", "ros", "sol", "tam", "vel"),
    "greek": ("βα", "γα", "δη", "ζα", "θα", "κο", "λα", "μα", "νι", "πα", "ρου", "σα", "τα", "φα", "χα", "ψα"),
    "cyrillic": ("ба", "вор", "гал", "дин", "жар", "зим", "кор", "лан", "мар", "нос", "пер", "рос", "сол", "тим", "хол", "чер"),
}


def kind_of(mention: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(mention.contains("@"), F.lit("email"))
        .when(mention.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), F.lit("ip"))
        .when(mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("ssn"))
        .when(mention.rlike(r"^[A-Z]{2}[0-9]{2}"), F.lit("iban"))
        .when(mention.rlike(r"^[0-9 -]+$") & (F.length(digits) == 16), F.lit("card"))
        .when(mention.rlike(r"^\p{L}"), F.lit("name"))
        .otherwise(F.lit("phone"))
    )


def normal(kind: Column, mention: Column) -> Column:
    """What makes two mentions one entity: the digits of numbers, those of a telephone number beside its country's, the folded address,
    the account without spaces, and the name without its honorific, but its gender."""
    female = F.regexp_extract(mention, r"^(\p{L}+)", 1).isin(*FEMALE)
    name = F.concat(F.when(female, F.lit("f:")).otherwise(F.lit("m:")), F.regexp_replace(mention, r"^\p{L}+\.? ", ""))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    apart = F.length(F.regexp_extract(mention, r"^\+([0-9]{1,3})[ .(-]", 1))
    code = F.when(apart > 0, apart).when(mention.rlike(r"^\+[17]"), F.lit(1)).otherwise(F.lit(2))
    phone = F.when(mention.startswith("+"), F.concat(F.lit("+"), F.substring(digits, F.lit(1), code), F.lit(":"), F.substring(digits, code + 1, F.length(digits)))).otherwise(digits)
    return F.when(kind == "email", F.lower(mention)).when(kind == "name", name).when(kind == "ip", mention).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind == "phone", phone).otherwise(digits)


def family_of(norm: Column) -> Column:
    """The family name in a normal name."""
    return F.substring_index(F.substring_index(norm, ":", -1), " ", -1)


def given_of(norm: Column) -> Column:
    """Gender and given name in a normal name, blank if it has none."""
    return F.when(norm.contains(" "), F.substring_index(norm, " ", 1)).otherwise(F.lit(""))


def _nibble(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) + 1, 1), 16, 10).cast("int")


def _digits(digest: Column, n: Column) -> Column:
    """n digits; two hash digits make one, so that all ten are near equally likely."""
    ds = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((_nibble(digest, i * 2) * 16 + _nibble(digest, i * 2 + 1)) % 10).cast("string"))
    return F.when(n > 0, F.array_join(ds, "")).otherwise(F.lit(""))


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), n % len(values) + 1)


def _shaped(text: Column, digest: Column) -> Column:
    letters = tuple("bcdfghjklmnprstv")

    def one(c: Column, i: Column) -> Column:
        n = _nibble(digest, i)
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike(r"\p{L}"), _pick(letters, n)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(body: Column) -> Column:
    """The body with the check digit that makes it valid."""
    return F.concat(body, F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: _valid(F.concat(body, d)))[0])


def _valid(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def _check_digits(country: Column, account: Column) -> Column:
    """The two digits that make an IBAN valid."""
    number = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int"))
    chars = F.split(F.concat(account, country, F.lit("00")), "")
    rest = F.aggregate(chars, F.lit(0), lambda r, c: (r * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + number(c)) % 97)
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The normal form of the surrogate of an entity. The hashes are made once, in an array of one, and read from there."""
    one = F.array(F.struct(F.sha2(F.concat_ws("\u0000", F.lit(key), kind, norm, attempt.cast("string")), 256).alias("d"), F.sha2(F.concat_ws("\u0000", F.lit(key), F.lit("domain"), F.substring_index(norm, "@", -1)), 256).alias("dd"), kind.alias("kind"), norm.alias("norm"), attempt.alias("t")))
    return F.transform(one, lambda x: _drawn(x["kind"], x["norm"], x["t"], x["d"], x["dd"]))[0]


def _drawn(kind: Column, norm: Column, attempt: Column, d: Column, dd: Column) -> Column:
    at = lambda i: _nibble(d, F.lit(i))
    byte = lambda i: at(i) * 16 + at(i + 1)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    more = F.least(attempt * 4, F.lit(32))
    host = F.when(attempt == 0, F.concat(F.lit("@"), _shaped(F.substring_index(domain, ".", 1), dd), F.substring(dd, 1, 3))).otherwise(F.concat(F.substring(d, F.lit(1), more), F.lit("@"), F.substring(dd, 1, 8)))
    email = F.concat(_shaped(local, d), host, F.lit(".example.net"))
    body = F.concat(F.substring(norm, 1, 1), _digits(d, F.length(norm) - 2))
    card = F.when(_valid(norm), _luhn(body)).otherwise(F.concat(body, _digits(F.reverse(d), F.lit(1))))
    inner = norm.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
    head = F.when(inner, F.lit("10")).otherwise((F.lit(11) + byte(0) % 100).cast("string"))
    ip = F.concat_ws(".", head, byte(2).cast("string"), byte(4).cast("string"), byte(6).cast("string"))
    kept, rest = F.when(norm.contains(":"), F.concat(F.substring_index(norm, ":", 1), F.lit(":"))).otherwise(F.lit("")), F.substring_index(norm, ":", -1)
    phone = F.concat(kept, F.when(F.length(rest) > 0, (at(50) % 8 + 2).cast("string")).otherwise(F.lit("")), _digits(d, F.length(rest) - 1))
    ssn = F.concat(F.lit("9"), _digits(d, F.lit(8)))
    country, account = F.substring(norm, 1, 2), F.substring(norm, F.lit(5), F.length(norm))
    new_account = F.upper(_shaped(account, d))
    right = _check_digits(country, account) == F.substring(norm, 3, 2)
    iban = F.concat(country, F.when(right, _check_digits(country, new_account)).otherwise(_digits(F.reverse(d), F.lit(2))), new_account)
    family, given = (_by_script(norm, lambda script, w=which: _part(script, w, norm, attempt, d)) for which in ("family", "given"))
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "family", family).when(kind == "given", given).otherwise(phone)


def _by_script(norm: Column, make) -> Column:
    return F.when(norm.rlike(r"\p{IsCyrillic}"), make("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), make("greek")).otherwise(make("latin"))


def _part(script: str, which: str, norm: Column, attempt: Column, d: Column) -> Column:
    """A family name of three syllables, or a given name of its gender; each further draw adds a syllable, the first one to a given name a hyphen too."""
    syllables = lambda n: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(SYLLABLES[script], _nibble(d, i))), ""))
    if which == "family":
        return syllables(F.least(attempt, F.lit(50)) + 3)
    first = F.when(norm.startswith("f:"), _pick(GIVEN[script, "f"], _nibble(d, F.lit(0)))).otherwise(_pick(GIVEN[script, "m"], _nibble(d, F.lit(0))))
    return F.concat(F.substring(norm, 1, 2), first, F.when(attempt > 0, F.concat(F.lit("-"), syllables(F.least(attempt, F.lit(50)) + 1))).otherwise(F.lit("")))


def rendered(kind: Column, mention: Column, new: Column) -> Column:
    """The surrogate of an entity other than a name, punctuated and spelled as the mention is."""
    given = F.when(kind == "iban", new).otherwise(F.regexp_replace(new, "[^0-9]", ""))
    filled = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda acc, c: F.struct(F.concat(acc["out"], F.when(c.rlike("[0-9A-Z]"), F.substring(given, acc["i"], F.lit(1))).otherwise(c)).alias("out"), (acc["i"] + c.rlike("[0-9A-Z]").cast("int")).alias("i")),
        lambda acc: acc["out"],
    )
    at = F.instr(mention, "@")
    email = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when((i + 1 < at) & F.substring(mention, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return F.when(kind == "email", email).when(kind == "ip", new).otherwise(filled)


#: Stand for U+0001, U+0002 and U+0003 in a text that is marked with the first two.
_ESCAPES = (("\u0003", "\u0003\u0003"), ("\u0001", "\u0003\u0004"), ("\u0002", "\u0003\u0005"))


def _escaped(text: Column) -> Column:
    out = text
    for plain, code in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.when(text.rlike("[\u0001-\u0003]"), out).otherwise(text)


def _unescaped(text: Column) -> Column:
    one = lambda x: F.replace(F.replace(x, F.lit("\u0003\u0004"), F.lit("\u0001")), F.lit("\u0003\u0005"), F.lit("\u0002"))
    return F.when(text.contains("\u0003"), F.array_join(F.transform(F.split(text, "\u0003\u0003"), one), "\u0003")).otherwise(text)


def _pieces(text: Column) -> Column:
    return F.split(F.regexp_replace(_escaped(text), ENTITY, f"{OPEN}$0{CLOSE}"), OPEN, -1)


def _staged(pieces: Column) -> Column:
    """Array of (m, rest, kind, norm): the mention that a piece begins with, blank for the first piece, and what follows it.

    Each stage reads the fields of the one before, so an expression stands once in the plan, however often it is used."""
    first = F.transform(pieces, lambda p, i: F.struct(F.when(i == 0, F.lit("")).otherwise(F.substring_index(p, CLOSE, 1)).alias("m"), p.alias("p"), i.alias("i")))
    cut = F.transform(first, lambda x: F.struct(x["m"].alias("m"), F.when(x["i"] == 0, x["p"]).otherwise(F.substring(x["p"], F.length(x["m"]) + 2, F.length(x["p"]))).alias("rest"), kind_of(x["m"]).alias("kind")))
    return F.transform(cut, lambda x: F.struct(x["m"].alias("m"), x["rest"].alias("rest"), x["kind"].alias("kind"), normal(x["kind"], x["m"]).alias("norm")))


def mentions(text: Column) -> Column:
    """Array of (kind, norm) of the entities in a text; a name is one of family and one of given name, if it has that."""
    one = lambda kind, norm: F.struct(kind.alias("kind"), norm.alias("norm"))
    names = lambda n: F.filter(F.array(one(F.lit("family"), family_of(n)), one(F.lit("given"), given_of(n))), lambda e: e["norm"] != "")
    found = F.filter(_staged(_pieces(text)), lambda x: x["m"] != "")
    return F.flatten(F.transform(found, lambda x: F.when(x["kind"] == "name", names(x["norm"])).otherwise(F.array(one(x["kind"], x["norm"])))))


def rewritten(text: Column, key: str, attempt) -> Column:
    """The pieces of a text with surrogates in them; attempt: kind and norm to the draw that counts."""
    new = lambda kind, norm: surrogate(kind, norm, attempt(kind, norm), key)
    e = _staged(_pieces(text))
    # the kind and the entity that a piece takes its surrogate from: of a name, the family name
    e = F.transform(e, lambda x: F.struct(x["m"].alias("m"), x["rest"].alias("rest"), x["kind"].alias("kind"), x["norm"].alias("norm"), F.when(x["kind"] == "name", F.lit("family")).otherwise(x["kind"]).alias("k"), F.when(x["kind"] == "name", family_of(x["norm"])).otherwise(x["norm"]).alias("n")))
    e = F.transform(e, lambda x: F.struct(x["m"].alias("m"), x["rest"].alias("rest"), x["kind"].alias("kind"), x["norm"].alias("norm"), x["n"].alias("n"), F.when(x["m"] != "", new(x["k"], x["n"])).alias("new")))

    def named(x: Column) -> Column:
        given = F.when(x["norm"].contains(" "), F.concat(F.substring_index(new(F.lit("given"), given_of(x["norm"])), ":", -1), F.lit(" "))).otherwise(F.lit(""))
        return F.concat(F.regexp_extract(x["m"], r"^(\p{L}+\.? )", 1), given, x["new"])

    e = F.transform(e, lambda x: F.struct(x["m"].alias("m"), x["rest"].alias("rest"), x["kind"].alias("kind"), x["n"].alias("n"), x["new"].alias("new"), F.when(x["m"] == "", F.lit("")).when(x["kind"] == "name", named(x)).otherwise(rendered(x["kind"], x["m"], x["new"])).alias("out")))

    def bare(pieces: Column) -> Column:
        """Family names that stand alone elsewhere in the text follow those with an honorific."""
        known = F.array_distinct(F.transform(F.filter(pieces, lambda x: (x["kind"] == "name") & (x["m"] != "")), lambda x: F.struct(x["n"].alias("n"), x["new"].alias("new"))))
        alone = lambda rest: F.aggregate(known, rest, lambda t, f: F.when(t.contains(f["n"]), F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), f["n"], F.lit(r"(?![\p{L}\p{N}])")), f["new"])).otherwise(t))
        return F.transform(pieces, lambda x: F.concat(x["out"], F.when(F.size(known) > 0, alone(x["rest"])).otherwise(x["rest"])))

    return F.transform(F.array(e), bare)[0]


def has_entity(text: Column) -> Column:
    titled = F.lit(False)
    for t in (*FEMALE, *MALE):
        titled = titled | text.contains(t)
    return (titled | text.rlike(HINT)) & text.rlike(ENTITY)


def redrawn(found: DataFrame, key: str, ws: Workspace, rounds: int = 200) -> DataFrame:
    """(kind, norm, attempt) with attempt > 0, of entities whose first surrogate clashed. found: (kind, norm), repeats allowed.

    The least of those that share a surrogate keeps it; a surrogate that is a real entity of its kind is drawn again. Names and addresses
    get a larger space with each draw; numbers have the space of their format, and where the corpus fills that, the rounds end in an error."""
    now = ws.table(found.distinct().withColumn("attempt", F.lit(0)), "entities")
    for i in range(rounds):
        drawn = ws.table(now.withColumn("new", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)), "drawn")
        real = now.select(F.col("kind").alias("rk"), F.col("norm").alias("rn"))
        firsts = drawn.groupBy("kind", "new").agg(F.count("*").alias("c"), F.min(F.struct("attempt", "norm")).alias("first"))
        bad_new = firsts.join(real, (F.col("kind") == F.col("rk")) & (F.col("new") == F.col("rn")), "left")
        bad = bad_new.where((F.col("c") > 1) | F.col("rn").isNotNull()).select("kind", "new", F.when(F.col("rn").isNull(), F.col("first.norm")).alias("keeps"))
        bad = ws.table(bad, "clashes")
        if not bad.limit(1).count():
            break
        marked_bad = bad.select("kind", "new", "keeps", F.lit(True).alias("clash"))
        again = drawn.join(marked_bad, ["kind", "new"], "left").select("kind", "norm", F.when(F.coalesce("clash", F.lit(False)) & ~F.col("norm").eqNullSafe(F.col("keeps")), F.lit(i + 1)).otherwise(F.col("attempt")).alias("attempt"))
        now = ws.table(again, "entities")
    else:
        raise ValueError("surrogates still clash: the corpus holds nearly all numbers of a format")
    return now.where("attempt > 0")


def replace(docs: DataFrame, key: str = "notelake", id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with surrogates in the text column; columns of the input, and the number of mentions if count_col is given."""
    ws = Workspace(docs.sparkSession, "pii")
    text = column(text_col).cast("string")
    found = docs.where(has_entity(text)).select(F.explode(mentions(text)).alias("m")).select("m.kind", "m.norm")
    odd = ws.table(redrawn(found, key, ws), "odd")
    n = odd.limit(MAP_ROWS + 1).count()
    frame, tries = docs, None
    name = lambda kind, norm: F.concat_ws(":", kind, norm)
    if n and n <= MAP_ROWS:
        rows = odd.collect()
        tries = F.create_map(*[x for r in rows for x in (F.lit(f"{r['kind']}:{r['norm']}"), F.lit(r["attempt"]))])
    elif n:
        row, drawn = free_name(docs, "row"), free_name(docs, "drawn")
        keyed = docs.withColumn(row, F.struct(F.xxhash64(text).alias("h"), F.xxhash64(column(id_col).cast("string"), F.lit(1)).alias("k")))
        some = keyed.where(has_entity(text)).select(F.col(row).alias("row"), F.explode(F.array_distinct(mentions(text))).alias("m")).select("row", "m.kind", "m.norm")
        per = some.join(odd, ["kind", "norm"]).distinct().groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("norm")), "attempt"))).alias(drawn))
        frame = keyed.join(ws.table(per.withColumnRenamed("row", row), "tries"), row, "left")
        tries = F.col(drawn)

    attempt = (lambda k, n: F.lit(0)) if tries is None else (lambda k, n: F.coalesce(F.try_element_at(tries, name(k, n)), F.lit(0)))
    new = free_name(docs, "pieces")
    done = frame.withColumn(new, F.when(has_entity(text), rewritten(text, key, attempt)))
    there = F.col(new).isNotNull()
    columns = [F.when(there, _unescaped(F.array_join(new, ""))).otherwise(text).alias(c) if c == text_col else column(c) for c in docs.columns]
    if count_col:
        columns.append(F.when(there, F.size(new) - 1).otherwise(F.lit(0)).cast("long").alias(count_col))
    return done.select(*columns)
