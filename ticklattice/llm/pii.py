"""Personal data: detection and keyed surrogates, in DataFrame functions only.

Entities are marked by one pass of regular expressions per kind.  Each gets a surrogate of its own kind: the digest of a
key, the kind and the entity's canonical form drives letters and digits, while the format (separators, case, the plus
sign, the issuer digit and checksum of a card, the title and with it the gender and script of a name) stays.  Equal
entities get equal surrogates wherever they stand.  Distinct ones are checked for collisions, with each other and with
what occurs in the texts; those that collide are drawn again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Where the session's configuration has the secret key of the surrogates.
KEY_CONF = "spark.ticklattice.surrogateKey"
#: Rows of redrawn entities up to which their table is broadcast; beyond, the join is left to Spark.
SMALL = 10_000
#: Characters of private use that mark entities, and the one that escapes all four where a text has them.
OPEN, SPLIT, CLOSE, ESCAPE = "\ue000", "\ue001", "\ue002", "\ue003"

# Titles by script and gender, and syllables of surrogate names.
TITLES = {
    ("latin", "m"): ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor"),
    ("latin", "f"): ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita"),
    ("latin", "n"): ("Dr", "Prof"),
    ("cyrillic", "m"): ("Господин", "господин"),
    ("cyrillic", "f"): ("Госпожа", "госпожа"),
    ("greek", "m"): ("Κύριος", "κύριος"),
    ("greek", "f"): ("Κυρία", "κυρία"),
}
FIRST = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oskar", "Paul"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helena", "Irma", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula"),
    ("latin", "n"): ("Alex", "Ariel", "Bo", "Charlie", "Dominique", "Eden", "Francis", "Gray", "Jo", "Kim", "Lou", "Noa", "Quinn", "Robin", "Sascha", "Toni"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"),
    ("cyrillic", "f"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"),
    ("greek", "m"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θανάσης", "Ιάσονας", "Κώστας", "Λεωνίδας", "Μάριος", "Νίκος", "Ορέστης", "Πέτρος", "Σπύρος", "Τάσος", "Φώτης", "Χρήστος"),
    ("greek", "f"): ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Καλλιόπη", "Λυδία", "Μαρία", "Νεφέλη", "Ουρανία", "Πηνελόπη", "Σοφία"),
}
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fe", "ga", "ka", "la", "le", "ma", "mo", "na", "ra", "ri", "so", "ta"),
    "cyrillic": ("ба", "ве", "га", "до", "же", "за", "ко", "ла", "ме", "но", "па", "ра", "со", "та", "фо", "ха"),
    "greek": ("βα", "γε", "δο", "ζα", "θε", "κα", "λο", "με", "να", "ξο", "πα", "ρε", "σο", "τα", "φε", "χα"),
}

# One part of a name: a capital, then letters; capitals and apostrophes may stand inside (O'Brien, McDonald).
_NAMES = {
    "latin": r"[A-ZÀ-ÖØ-Þ](?:['’]?[A-Za-zÀ-ÖØ-öø-ÿ]){1,30}",
    "cyrillic": r"[А-ЯЁ][А-Яа-яЁё]{1,30}",
    "greek": r"[Α-ΫΆ-Ώ][Α-ΫΆ-Ώά-ώ]{1,30}",
}
# Country calling codes by their length.
_CALLING = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Kinds and what marks them, asked in this order; later kinds don't look into what earlier ones marked.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?<![0-9A-Za-z])(?i:password|passwd|token|secret|api_?key)(?: ?[=:] ?)[\"']?(?=[A-Za-z_./+-]{0,127}[0-9])[0-9A-Za-z_./+-]{12,}+[\"']?"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![0-9.+-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9.-]?[0-9])"),
    ("card", r"(?<![0-9.+-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9.-]?[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])"),
)
KINDS = (*dict.fromkeys(k for k, _ in PATTERNS), *(f"name_{script}" for script in _NAMES))
# What a text must hold for any pattern to fit: every kind but the names and one key needs a digit or an @ sign.
_SIGN = r"[0-9@]|A(?:KIA|SIA)"
_TITLES = [t for titles in TITLES.values() for t in titles]
_TITLE = f"(?=[{''.join(sorted({t[0] for t in _TITLES}))}])(?:{'|'.join(_TITLES)})" + r"\.? "


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, and stands once in the plan however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _escaped(text: Column) -> Column:
    """The text with the marks' own characters written as pairs."""
    for k, mark in enumerate((ESCAPE, OPEN, SPLIT, CLOSE)):
        text = F.replace(text, F.lit(mark), F.lit(ESCAPE + "3012"[k]))
    return text


def _unescaped(text: Column) -> Column:
    for k, mark in enumerate((OPEN, SPLIT, CLOSE, ESCAPE)):
        text = F.replace(text, F.lit(ESCAPE + str(k)), F.lit(mark))
    return text


def _strange(text: Column) -> Column:
    return text.rlike(f"[{OPEN}-{ESCAPE}]")


def marked(text: Column) -> Column:
    """The text with each entity as OPEN kind SPLIT entity CLOSE; such marks in the text itself are escaped before.

    A name is marked by its parts after the title: given names with what follows them, then the family name.
    """
    # Not in what is marked already: no CLOSE comes soon, before an OPEN.  Only secrets can be longer, in letters of their own.
    outside = f"(?![^{OPEN}{CLOSE}]{{0,700}}+{CLOSE})(?![0-9A-Za-z_./+-]*+[\"']?{CLOSE})"

    def signs(plain: Column) -> Column:
        found = plain
        for kind, pattern in PATTERNS:
            if kind == "email":
                found = F.when(F.instr(found, "@") > 0, F.regexp_replace(found, f"({pattern})", f"{OPEN}{kind}{SPLIT}$1{CLOSE}")).otherwise(found)
            else:
                found = F.regexp_replace(found, f"({pattern}){outside}", f"{OPEN}{kind}{SPLIT}$1{CLOSE}")
        return F.when(text.rlike(_SIGN), found).otherwise(plain)

    def names(signed: Column) -> Column:
        found = signed
        for (script, gender), titles in TITLES.items():
            part, given = _NAMES[script], f"{OPEN}given_{script}_{gender}{SPLIT}"
            pattern = rf"(?<![\p{{L}}])((?:{'|'.join(titles)})\.? )((?:{part}[ -])?)((?:{part}[ -])?)({part})(?![\p{{L}}]){outside}"
            found = F.regexp_replace(found, pattern, f"$1{given}$2{CLOSE}{given}$3{CLOSE}{OPEN}name_{script}{SPLIT}$4{CLOSE}")
        return F.when(text.rlike(_TITLE), found).otherwise(signed)

    plain = F.when(_strange(text), _escaped(text)).otherwise(text)
    return _once(_once(plain, signs), names)


def pieces(mark: Column) -> Column:
    """Array of (kind, value): stretches of text (kind null) and entities, in order."""
    parts = F.filter(F.split(mark, f"[{OPEN}{CLOSE}]"), lambda p: ~p.endswith(SPLIT) & (p != ""))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(F.instr(p, SPLIT) > 0, F.substring_index(p, SPLIT, 1)).alias("kind"),
            F.when(F.instr(p, SPLIT) > 0, F.substring_index(p, SPLIT, -1)).otherwise(p).alias("value"),
        ),
    )


def canonical(kind: Column, value: Column) -> Column:
    """What two mentions of the same entity share: digits of numbers, letters of an address in lower case, a bare name."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    name = F.lower(F.regexp_replace(value, "[ -]$", ""))
    secret = F.regexp_replace(value, r"^.*[=: \"']([0-9A-Za-z_./+-]{12,})[\"']?$", "$1")
    return (
        F.when(kind.isin("card", "ssn", "phone"), digits)
        .when(kind == "email", F.lower(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "secret", secret)
        .when(kind.startswith("name") | kind.startswith("given"), name)
        .otherwise(value)
    )


def _nibble(digest: Column, k: Column) -> Column:
    """The k-th hexadecimal digit of a digest as a number, going round."""
    return F.conv(digest.substr(k % 64 + 1, F.lit(1)), 16, 10).cast("int")


def _pair(digest: Column, k: Column) -> Column:
    return _nibble(digest, k * 2) * 16 + _nibble(digest, k * 2 + 1)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of one entity, in the format of this mention."""

    def drawn(attempt: Column) -> Column:
        digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical(kind, value), attempt.cast("string")), 256)
        return _once(digest, lambda d: _drawn(kind, value, attempt, d))

    return _once(attempt, drawn)


def _drawn(kind: Column, value: Column, attempt: Column, digest: Column) -> Column:
    """``surrogate`` by the digest of its key, kind, canonical form and attempt."""
    # Each letter or digit is replaced by one of its kind, drawn by its place among the letters and digits.
    def redraw(source: Column, keep: int = 0) -> Column:
        def one(c: Column, i: Column) -> Column:
            at = F.length(F.regexp_replace(source.substr(F.lit(1), i), r"[^0-9A-Za-z]", ""))
            return F.when(i < keep, c).otherwise(_once(at, lambda at: _once(_pair(digest, at), lambda drawn: (
                F.when(c.rlike("[0-9]"), (drawn % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.char(drawn % 26 + 97))
                .when(c.rlike("[A-Z]"), F.char(drawn % 26 + 65))
                .otherwise(c)
            ))))

        return F.array_join(F.transform(F.split(source, ""), one), "")

    domain = F.lower(F.substring_index(value, "@", -1))
    # The top-level domain stays; "example" domains belong to nobody.
    mail = F.concat(F.substring(digest, 1, 10), F.lit("."), F.substring(digest, 11, 4), F.lit("@example."), F.substring_index(domain, ".", -1))

    def numbered(keep_first: int, plus: bool) -> Column:
        """Digits drawn by their place among the digits; a country code and ``keep_first`` digits stay."""
        head = F.regexp_extract(value, rf"^\+{_CALLING}", 0) if plus else F.lit("")
        rest = value.substr(F.length(head) + 1, F.length(value))

        def digit(c: Column, at: Column, drawn: Column) -> Column:
            first = F.when(at == 0, drawn % 8 + 2).otherwise(drawn % 10) if plus else drawn % 10
            return F.when(c.rlike("[0-9]") & (at >= keep_first), first.cast("string")).otherwise(c)

        def one(c: Column, i: Column) -> Column:
            at = F.length(F.regexp_replace(rest.substr(F.lit(1), i), r"[^0-9]", ""))
            return _once(at, lambda at: _once(_pair(digest, at), lambda drawn: digit(c, at, drawn)))

        return F.concat(head, F.array_join(F.transform(F.split(rest, ""), one), ""))

    # A card keeps its first digit and gets the check digit that makes its Luhn sum right.
    def checked(card: Column, body: Column) -> Column:
        luhn = F.aggregate(
            F.sequence(F.lit(1), F.length(body) - 1),
            F.lit(0),
            lambda acc, i: acc
            + F.when((F.length(body) - i) % 2 == 1, _doubled(body.substr(i, F.lit(1)).cast("int"))).otherwise(body.substr(i, F.lit(1)).cast("int")),
        )
        return F.concat(card.substr(F.lit(1), F.length(card) - 1), ((F.lit(10) - luhn % 10) % 10).cast("string"))

    card = _once(numbered(1, False), lambda card: _once(F.regexp_replace(card, r"[^0-9]", ""), lambda body: checked(card, body)))
    octets = F.array_join(
        F.array(*[F.when(F.lit(k) > 0, _pair(digest, F.lit(k)) % 256).otherwise(_pair(digest, F.lit(k)) % 222 + 1).cast("string") for k in range(4)]), "."
    )
    quote = F.regexp_extract(value, r"^(.*[=: \"'])[0-9A-Za-z_./+-]{12,}[\"']?$", 1)
    body_of = F.regexp_extract(value, r"([0-9A-Za-z_./+-]{12,})[\"']?$", 1)
    tail = F.regexp_extract(value, r"[\"']?$", 0)
    hexed = F.array_join(F.transform(F.split(body_of, ""), lambda c, i: F.lower(F.hex(_nibble(digest, i) % 16)).substr(F.lit(-1), F.lit(1))), "")
    secret = F.when(F.length(quote) > 0, F.concat(quote, hexed, tail)).otherwise(redraw(value, 4))

    # An IBAN keeps its country and gets the check digits that its account number asks for.
    def certified(account: Column) -> Column:
        moved = F.concat(F.regexp_replace(account.substr(F.lit(5), F.length(account)), " ", ""), F.substring(value, 1, 2), F.lit("00"))
        rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(
            c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
        return F.concat(F.substring(value, 1, 2), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), account.substr(F.lit(5), F.length(account)))

    iban = _once(redraw(value, 4), certified)

    out = (
        F.when(kind == "email", mail)
        .when(kind == "card", card)
        .when(kind == "ssn", numbered(0, False))
        .when(kind == "phone", numbered(0, True))
        .when(kind == "ip", octets)
        .when(kind == "iban", iban)
        .when(kind == "secret", secret)
    )

    def syllables(script: str, start: int, count: Column) -> Column:
        part = F.array(*map(F.lit, SYLLABLES[script]))
        return F.array_join(F.transform(F.sequence(F.lit(start), start + count - 1), lambda k: F.element_at(part, _nibble(digest, k) + 1)), "")

    # Names that collide are drawn again a syllable longer, so there are always enough of them.
    for script in SYLLABLES:
        out = out.when(kind == f"name_{script}", F.initcap(syllables(script, 0, attempt + 4)))
    for (script, gender), firsts in FIRST.items():
        first = F.element_at(F.array(*map(F.lit, firsts)), _nibble(digest, F.lit(0)) + 1)
        longer = F.when(attempt > 0, syllables(script, 1, F.greatest(attempt, F.lit(1)))).otherwise("")
        out = out.when(kind == f"given_{script}_{gender}", F.concat(first, longer, F.regexp_extract(value, "[ -]$", 0)))
    return out


def _doubled(x: Column) -> Column:
    return F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)


def entities(docs: DataFrame) -> DataFrame:
    """(kind, canon, value): the distinct entities of ``docs`` (text), with one way each is written.

    Null and empty texts have none; repeats, in one text or many, are one row; of several spellings the least is taken.
    """
    found = docs.select(F.explode(F.filter(pieces(marked(F.col("text"))), lambda p: p.kind.isNotNull())).alias("p"))
    canon = canonical(F.col("p.kind"), F.col("p.value"))
    return found.groupBy(F.col("p.kind").alias("kind"), canon.alias("canon")).agg(F.min("p.value").alias("value"))


def redrawn(found: DataFrame, *, key: str, rounds: int = 12) -> DataFrame:
    """(kind, canon, attempt) of entities (kind, canon, value) whose first surrogate is that of another, or is itself an entity.

    Of those that draw the same the first in order keeps it; the rest draw again until no two agree.  An empty table gives
    an empty one; values of any length are drawn whole; the table's rows are distinct in (kind, canon), none is null.
    """
    spark = found.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = shared.written(found.withColumn("attempt", F.lit(0)), "entities")
    real = now.select("kind", F.col("canon").alias("taken"))
    for _ in range(rounds):
        # A small table is one file, but drawing takes time: spread its rows.
        spread = now.repartition(tasks, "kind", "canon")
        drawn = spread.withColumn("drawn", _once(surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key), lambda s: canonical(F.col("kind"), s)))
        drawn = shared.written(drawn.select("kind", "canon", "drawn"), "drawn")
        keepers = drawn.groupBy("kind", "drawn").agg(F.min("canon").alias("keeper"), F.count(F.lit(1)).alias("n"))
        shared_by = keepers.filter("n > 1").select("kind", "drawn", "keeper")
        again = drawn.join(shared_by, ["kind", "drawn"]).filter("canon <> keeper").select("kind", "canon")
        again = again.union(drawn.join(real, (drawn.kind == real.kind) & (drawn.drawn == real.taken), "left_semi").select("kind", "canon"))
        again = shared.written(again.distinct().withColumn("hit", F.lit(1)), "again")
        if again.limit(1).count() == 0:
            break
        now = shared.written(
            now.join(again, ["kind", "canon"], "left").select("kind", "canon", "value", (F.col("attempt") + F.coalesce("hit", F.lit(0))).alias("attempt")),
            "entities",
        )
    else:
        raise ValueError("surrogates still collide; a kind has too few of them for its entities")
    return now.filter("attempt > 0").select("kind", "canon", "attempt")


def session_key(spark: SparkSession) -> str:
    """The secret key that the session's configuration names; whoever knows it can link surrogates to what they replace."""
    key = spark.conf.get(KEY_CONF, "")
    if not key:
        raise ValueError(f"set {KEY_CONF} to a secret key, or give one")
    return key


def replace(docs: DataFrame, *, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in place of the personal data in ``text``, and n_entities and kinds (found, sorted) added.

    The key is the session's (see ``session_key``) unless given.  All other columns stay as they are (columns named
    n_entities or kinds are replaced).  A null text stays null and an empty one empty, with 0 entities; texts of any length
    are searched whole, in time that grows with them; an empty table gives an empty one.  Equal entities get equal
    surrogates in all rows, a family name also with another title or given name; distinct ones get distinct ones.
    """
    key = key or session_key(docs.sparkSession)
    again = shared.written(redrawn(entities(docs.select(F.col(text).alias("text"))), key=key), "redrawn")
    size = again.limit(SMALL + 1).count()
    found = pieces(marked(F.col(text)))
    names = [c for c in docs.columns if c not in (text, "n_entities", "kinds")]
    rows = docs.withColumn("__pieces", found)
    if size == 0:
        attempt = lambda p: F.lit(0)
    elif size <= SMALL:
        listed = {f"{r['kind']}\x1f{r['canon']}": r["attempt"] for r in again.collect()}  # at most SMALL rows
        rows = rows.withColumn("__attempts", F.from_json(F.lit(json.dumps(listed)), "map<string,int>"))
        attempt = lambda p: F.coalesce(F.try_element_at("__attempts", F.concat(p.kind, F.lit("\x1f"), canonical(p.kind, p.value))), F.lit(0))
    else:
        # Each row's redrawn entities come by a plain join and gather by a row key.
        rows = shared.written(rows.withColumn("__row", F.monotonically_increasing_id()), "marked")
        own = rows.select("__row", F.explode("__pieces").alias("p")).filter("p.kind is not null").select(
            "__row", F.col("p.kind").alias("kind"), canonical(F.col("p.kind"), F.col("p.value")).alias("canon")
        ).distinct()
        own = own.join(again, ["kind", "canon"]).select("__row", F.concat("kind", F.lit("\x1f"), "canon").alias("k"), "attempt")
        maps = own.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("__attempts"))
        rows = rows.join(maps, "__row", "left")
        attempt = lambda p: F.coalesce(F.try_element_at("__attempts", F.concat(p.kind, F.lit("\x1f"), canonical(p.kind, p.value))), F.lit(0))
    new = F.array_join(F.transform("__pieces", lambda p: F.when(p.kind.isNull(), p.value).otherwise(surrogate(p.kind, p.value, attempt(p), key))), "")
    new = F.when(_strange(F.col(text)), _unescaped(new)).otherwise(new)
    only = F.filter("__pieces", lambda p: p.kind.isNotNull() & ~p.kind.startswith("given"))  # a name counts once
    out = rows.select(
        *[F.col(f"`{c}`") for c in names],
        new.alias(text),
        F.coalesce(F.size(only), F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(only, lambda p: p.kind))), F.array().cast("array<string>")).alias("kinds"),
    )
    return out.withColumn("n_entities", F.greatest("n_entities", F.lit(0)))
