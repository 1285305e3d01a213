"""Personal data replaced by keyed surrogates, in DataFrame and SQL functions only.

Found are e-mail addresses, IPv4 and IPv6 addresses, bank accounts (IBAN with valid check digits), payment cards (with a
valid check digit and issuer), phone numbers, US social security numbers, hexadecimal secrets, and names after a form of
address; in a text that holds such a name, its words are also replaced where they stand without the form of address. Each
distinct entity, known by its normal form (digits without the country code 1, lower case, addresses written out), gets a
surrogate from a keyed SHA-512: same entity, same surrogate, in every document and every spelling; a name's words are the
same under each form of address. Surrogates have the type and the format of what they replace: digits for digits in the
same layout, cards and accounts with valid check digits, given names of the gender that most forms of address in the
corpus tell, in the same script. An IPv6 address is written out in full.

A surrogate that equals a real entity, or that another entity has, is drawn again, in rounds over the entities that clash,
so distinct entities stay distinct. From the third such round on addresses, and from the eighth on numbers, grow by a sign
a round, and what is still without one after ROUNDS rounds gets its kind and a digest: no entity is left without.

The texts are searched once, and staged with what was found. Entities in very many documents (more than HOT of them, and
more than a ten-thousandth of all finds, so there are at most 10,000 such) join by broadcast, the others by a shuffle.

Defined cases: a null text stays null and an empty one empty, with no entities; repeated rows are treated alike, also those
with a null id; entities that fail validation stay; long texts are read whole. Other columns pass through unchanged.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import HOT_ROWS, HOT_SHARE, staged

ROUNDS = 24
HOT = HOT_ROWS

# Forms of address, by the gender they tell, and the syllables that invented names are made of.
MALE = "Mr Herr Señor Monsieur господин".split()
FEMALE = "Mrs Ms Miss Frau Señora Madame Mme госпожа".split()
NEUTRAL = "Dr Prof".split()
LATIN = "ba de fi go lu ma ne pi ro sa te vi ka lo mi na".split()
CYRILLIC = "ба де фи го лу ма не пи ро са те ви ка ло ми на".split()

_TITLE = "|".join(sorted([*MALE, *FEMALE, *NEUTRAL], key=len, reverse=True))  # Mrs before Mr
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}-]+"
# All that is found starts where no word goes on, so the whole pattern asks that first.
_EMAIL = r"(?<![.+-])[\w.+-]++@[\w-]{1,63}(?:\.[\w-]{1,63}){0,8}\.[A-Za-z]{2,}"
_IP = rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)"
_IP6 = rf"(?<![:.])(?=[A-Fa-f:]{{0,38}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,6}}{_HEX}|(?:{_HEX}:){{2,7}}:)(?![\w:])"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
_CARD = r"(?<!\.)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\w)"
_PHONE = r"(?<!\+)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<!\+)\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w)|(?<![+.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)"
_SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])"
_SECRET = r"(?=[0-9a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,64}(?!\w)"
_NAME = rf"(?:{_TITLE})\.?(?: {_WORD}){{1,3}}"
_NUMBERS = "|".join([_IP6, _IP, _IBAN, _CARD, _PHONE, _SSN, _SECRET])


def _any_of(*kinds: str) -> str:
    return rf"(?U)(?<!\w)(?:{'|'.join(kinds)})"


PATTERN = _any_of(_EMAIL, _NUMBERS, _NAME)
_BARE = rf"(?U)(?<!\p{{L}}){_WORD}"
NAMES = ("given", "family")


def _found(text: Column) -> Column:
    """All that the pattern finds, null if it can find nothing; kinds that a text has no sign of are not looked for."""
    signs = [(_EMAIL, text.contains("@")), (_NUMBERS, text.rlike("[0-9]")), (_NAME, reduce(or_, [text.contains(t) for t in [*MALE, *FEMALE, *NEUTRAL]]))]
    out = F.when(text.isNull(), None)
    for n in (3, 2, 1):
        for some in combinations(signs, n):
            out = out.when(reduce(and_, [sign for _, sign in some]), F.regexp_extract_all(text, F.lit(_any_of(*[kind for kind, _ in some])), F.lit(0)))
    return out


def _kind(surface: Column) -> Column:
    digits = _digits(surface)
    return (
        F.when(surface.contains("@"), "email")
        .when(surface.rlike(r"^\d+(?:\.\d+){3}$"), "ip")
        .when(surface.rlike(r"^[0-9A-Fa-f:]+$") & surface.contains(":"), "ip6")
        .when(surface.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$") & ~surface.rlike("^[0-9A-F]{32,64}$"), "iban")
        .when(surface.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(surface.rlike(r"^[\d -]+$") & F.length(digits).between(13, 19), "card")
        .when(surface.rlike(r"^[0-9a-fA-F]{32,64}$"), "secret")
        .when(surface.rlike(r"^[+(\d]"), "phone")
        .otherwise("name")
    )


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits, those at places of the given parity from the right doubled and cast out."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def value(i: Column) -> Column:
        d = F.coalesce(F.expr("0") + F.try_to_number(F.substr(F.reverse(digits), i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0))
        return F.when(i % 2 == doubled, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b)


def _mod97(account: Column) -> Column:
    """Remainder by 97 of an account number whose letters count from 10 and whose first four signs come last."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    places = F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1)))
    values = F.transform(places, lambda i: F.ascii(F.substr(turned, i, F.lit(1))))
    values = F.transform(values, lambda a: F.when(a >= 65, a - 55).otherwise(F.greatest(a - 48, F.lit(0))))
    return F.aggregate(values, F.lit(0), lambda r, v: (F.when(v > 9, r * 100).otherwise(r * 10) + v) % 97)


def _compact(surface: Column) -> Column:
    return F.regexp_replace(surface, " ", "")


def _valid(kind: Column, surface: Column) -> Column:
    digits = _digits(surface)
    card = digits.rlike("^(?:[3-6]|2[2-7])") & (_luhn_sum(digits, 0) % 10 == 0)
    groups = F.size(F.filter(F.split(surface, ":"), lambda g: g != ""))
    ip6 = F.when(surface.contains("::"), groups < 8).otherwise(groups == 8)
    return F.when(kind == "card", card).when(kind == "iban", _mod97(_compact(surface)) == 1).when(kind == "ip6", ip6).otherwise(F.lit(True))


def _written_out(address: Column) -> Column:
    """An IPv6 address with all eight groups, lower case and without leading zeros."""

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    left, right = groups(F.substring_index(address, "::", 1)), groups(F.substring_index(address, "::", -1))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
    every = F.when(address.contains("::"), filled).otherwise(groups(address))
    return F.lower(F.array_join(F.transform(every, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"))


def _key(kind: Column, surface: Column) -> Column:
    """The normal form."""
    digits = _digits(surface)
    return (
        F.when(kind == "phone", F.regexp_replace(digits, r"^1(?=\d{10}$)", ""))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "ip6", _written_out(surface))
        .when(kind == "iban", _compact(surface))
        .otherwise(F.lower(surface))
    )


def _made_name(kind: Column, key: Column, gender: Column, stream: Column, syllables: int) -> Column:
    def spoken(table: list[str]) -> Column:
        parts = F.array(*[F.lit(s) for s in table])
        return F.concat(*[F.element_at(parts, (F.conv(F.substring(stream, 2 * i + 1, 2), 16, 10).cast("int") % len(table)) + 1) for i in range(syllables)])

    cyrillic = key.rlike(r"\p{IsCyrillic}")
    female, male = F.when(cyrillic, "ла").otherwise("la"), F.when(cyrillic, "н").otherwise("n")
    family = F.when(cyrillic, "р").otherwise("r")
    ending = F.when(kind == "family", family).when(gender == "f", female).when(gender == "m", male).otherwise("")
    return F.concat(F.when(cyrillic, spoken(CYRILLIC)).otherwise(spoken(LATIN)), ending)


def _draw(kind: Column, key: Column, gender: Column, secret: str, attempt: int) -> Column:
    """The surrogate's normal form."""
    stream = F.concat(*[F.sha2(F.concat_ws("\u0000", F.lit(secret), kind, key, F.lit(f"{attempt}.{k}")), 512) for k in range(2)])
    figures, letters = F.translate(stream, "abcdef", "135790"), F.translate(stream, "0123456789", "ghijklmnop")
    n = F.length(key) + max(0, attempt - 6)
    first = F.substring(key, 1, 1)
    body = F.concat(first, F.substr(figures, F.lit(1), n - 2))
    card = F.concat(body, ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string"))
    octets = [F.conv(F.substring(stream, 1 + 2 * k, 2), 16, 10).cast("int") for k in range(4)]
    ip = F.concat_ws(".", octets[0] % 223 + 1, octets[1], octets[2], octets[3])
    ip6 = F.concat_ws(":", *[F.regexp_replace(F.substring(stream, 1 + 4 * k, 4), "^0+(?=.)", "") for k in range(8)])
    stem = F.concat(F.lit("a" * max(0, attempt - 1)), F.regexp_extract(key, r"^(.*)\.[^.]*$", 1))

    def like(text: Column) -> Column:
        """text with other digits and letters, sign by sign."""

        def sign(i: Column) -> Column:
            c, at = F.substr(text, i, F.lit(1)), (i - 1) % 256 + 1
            return F.when(c.rlike("[0-9]"), F.substr(figures, at, F.lit(1))).when(c.rlike(r"\p{L}"), F.substr(letters, at, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), sign), "")

    email = F.concat(like(stem), F.lit("."), F.regexp_extract(key, r"([^.]*)$", 1))
    country, account = F.substring(key, 1, 2), F.upper(like(F.substr(key, F.lit(5))))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "ip6", ip6)
        .when(kind == "iban", iban)
        .when(kind == "card", card)
        .when(kind.isin("phone", "ssn"), F.concat(first, F.substr(figures, F.lit(1), n - 1)))
        .when(kind == "secret", F.substr(stream, F.lit(1), n))
        .otherwise(_made_name(kind, key, gender, stream, 3 + attempt % 12))
    )


def _in_layout(surface: Column, signs: Column, which: str) -> Column:
    """surface with its signs of the class `which` replaced, one by one; those that have no place follow."""
    count = lambda text: F.length(F.regexp_replace(text, f"[^{which}]", ""))

    def place(i: Column) -> Column:
        c = F.substr(surface, i, F.lit(1))
        return F.when(c.rlike(f"[{which}]"), F.substr(signs, count(F.substr(surface, F.lit(1), i)), F.lit(1))).otherwise(c)

    laid = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(surface), F.lit(1))), place), "")
    return F.concat(laid, F.substr(signs, count(surface) + 1))


def _rendered(kind: Column, surface: Column, key: Column, drawn: Column) -> Column:
    cased = F.when(F.upper(surface) == surface, F.upper(drawn)).otherwise(drawn)
    country = F.when((kind == "phone") & (F.length(_digits(surface)) > F.length(key)), "1").otherwise("")
    return (
        F.when(F.startswith(drawn, F.concat(kind, F.lit("-"))), drawn)
        .when(kind.isin("phone", "card", "ssn"), _in_layout(surface, F.concat(country, drawn), "0-9"))
        .when(kind == "iban", _in_layout(surface, drawn, "A-Z0-9"))
        .when(kind.isin("email", "secret"), F.when(surface.rlike(r"\p{L}"), cased).otherwise(drawn))
        .when(kind.isin("ip", "ip6"), drawn)
        .otherwise(_named(surface, drawn))
    )


def _named(surface: Column, drawn: Column) -> Column:
    return F.when((F.upper(surface) == surface) & (F.length(surface) > 1), F.upper(drawn)).otherwise(F.initcap(drawn))


def _parts(surface: Column) -> Column:
    """A name's words with their kinds and the gender told; any other entity whole. One struct (kind, surface, gender) each."""
    kind = _kind(surface)
    title = F.regexp_extract(surface, rf"^({_TITLE})", 1)
    words = F.regexp_extract_all(F.regexp_replace(surface, rf"^(?:{_TITLE})\.?", ""), F.lit(f"({_WORD})"), F.lit(1))
    gender = F.when(title.isin(MALE), "m").when(title.isin(FEMALE), "f").otherwise("")

    def part(kind: Column, surface: Column, gender: Column) -> Column:
        return F.struct(kind.alias("kind"), surface.alias("surface"), gender.alias("gender"))

    named = F.transform(words, lambda w, i: part(F.when((i == 0) & (F.size(words) > 1), "given").otherwise("family"), w, gender))
    return F.when(kind == "name", named).otherwise(F.array(part(kind, surface, F.lit(""))))


def assign(units: DataFrame, secret: str, rounds: int = ROUNDS) -> DataFrame:
    """units (kind, key, gender), distinct by kind and key -> (kind, key, drawn): one surrogate each, none shared, none a real key of that kind."""
    units = staged(units.select("kind", "key", "gender"), "units")
    taken = None
    left = units
    for attempt in range(rounds + 1):
        drawn = _draw(F.col("kind"), F.col("key"), F.col("gender"), secret, attempt)
        if attempt == rounds:
            drawn = F.concat("kind", F.lit("-"), F.substring(F.sha2(F.concat_ws("\u0000", F.lit(secret), "kind", "key"), 256), 1, 32))
        trial = left.select("kind", "key", drawn.alias("drawn"))
        trial = trial.join(units.select("kind", F.col("key").alias("drawn")), ["kind", "drawn"], "left_anti")
        if taken is not None:
            trial = trial.join(taken.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        won = staged(trial.groupBy("kind", "drawn").agg(F.min("key").alias("key")).select("kind", "key", "drawn"), f"round{attempt}")
        taken = won if taken is None else taken.union(won)
        left = staged(left.join(won.select("kind", "key"), ["kind", "key"], "left_anti"), f"left{attempt}")
        if not left.take(1):
            break
    return taken


def _spread(surfaces: DataFrame, surrogates: DataFrame) -> DataFrame:
    """surfaces joined with surrogates on entity, without gathering the rows of an entity that very many documents hold."""
    counts = staged(surfaces.groupBy("entity").agg(F.count("*").alias("held")), "held")
    total = counts.agg(F.sum("held")).first()[0] or 0
    often = F.broadcast(counts.where(F.col("held") > max(HOT, total // HOT_SHARE)).select("entity"))  # 10,000 rows at most
    hot = surfaces.join(often, "entity", "left_semi").join(F.broadcast(surrogates.join(often, "entity", "left_semi")), "entity")
    cold = surfaces.join(often, "entity", "left_anti").join(surrogates.join(often, "entity", "left_anti"), "entity")
    return hot.unionByName(cold)


def replace_entities(documents: DataFrame, secret: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with text_col rewritten, and n_entities: how many entities were replaced."""
    text = F.col(f"`{text_col}`").cast("string")
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), _found(text).alias("found"))
    # Numbers of rows are settled by staging: a lost executor does not deal them anew.
    base = staged(whole.withColumn("number", F.monotonically_increasing_id()), "found")
    base = base.withColumn("text", F.col(f"row.`{text_col}`").cast("string"))

    surfaces = base.where(F.size("found") > 0).select("number", F.explode(F.array_distinct("found")).alias("entity"))
    surfaces = staged(surfaces.where(_valid(_kind(F.col("entity")), F.col("entity"))), "entities")
    parts = surfaces.select("entity").distinct().select("entity", F.posexplode(_parts(F.col("entity"))).alias("place", "part")).select("entity", "place", "part.*")
    parts = staged(parts.withColumn("key", _key(F.col("kind"), F.col("surface"))), "parts")
    told = F.sum(F.when(F.col("gender") == "m", 1).when(F.col("gender") == "f", -1).otherwise(0))
    units = parts.groupBy("kind", "key").agg(F.when(told > 0, "m").when(told < 0, "f").otherwise("").alias("gender"))
    drawn = parts.join(assign(units, secret), ["kind", "key"])
    new = _rendered(F.col("kind"), F.col("surface"), F.col("key"), F.col("drawn"))
    together = drawn.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "key", "drawn", new.alias("new")))).alias("parts"))
    title = F.regexp_extract("entity", rf"^((?:{_TITLE})\.?) ", 1)
    plain = F.element_at("parts", 1)
    named = plain["kind"].isin(*NAMES)
    renamed = F.concat_ws(" ", title, F.array_join(F.transform("parts", lambda p: p["new"]), " "))
    words = F.when(named, F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), p["key"].alias("key"), p["drawn"].alias("drawn"))))
    surrogates = staged(together.select("entity", F.when(named, renamed).otherwise(plain["new"]).alias("new"), words.alias("words")), "surrogates")
    maps = _spread(surfaces, surrogates).groupBy("number").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("swap"),
        F.flatten(F.collect_list("words")).alias("words"),
    )

    def lookup(kind: str) -> Column:
        """A document's names of one kind: what replaces each word."""
        own = F.filter("words", lambda w: w["kind"] == kind)
        return F.map_from_entries(F.array_distinct(F.transform(own, lambda w: F.struct(w["key"].alias("key"), w["drawn"].alias("drawn")))))

    maps = staged(maps.select("number", "swap", *[F.when(F.size("words") > 0, lookup(k)).alias(k) for k in NAMES]), "maps")
    marked = F.coalesce(F.size("found") > 0, F.lit(False))
    both = base.where(marked).join(maps, "number", "left")  # texts without finds are not shuffled

    def bare(piece: Column) -> Column:
        """A stretch between entities, as (text, number of replaced words)."""
        own = F.regexp_extract_all(piece, F.lit(_BARE), F.lit(0))
        drawn = F.transform(own, lambda w: F.coalesce(F.try_element_at("family", F.lower(w)), F.try_element_at("given", F.lower(w))))
        new = F.zip_with(own, drawn, lambda w, d: F.coalesce(_named(w, d), w))
        between = F.split(piece, _BARE, -1)
        joined = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(own)), new, lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
        return F.struct(joined.alias("text"), F.size(F.filter(drawn, lambda d: d.isNotNull())).alias("n"))

    pieces = F.split("text", PATTERN, -1)
    pieces = F.when(F.col("family").isNotNull(), F.transform(pieces, bare)).otherwise(F.transform(pieces, lambda p: F.struct(p.alias("text"), F.lit(0).alias("n"))))
    both = both.withColumn("pieces", F.when(F.col("swap").isNotNull(), pieces))
    swapped = F.transform("found", lambda e: F.coalesce(F.try_element_at("swap", e), e))
    joined = F.concat(F.array_join(F.zip_with(F.slice("pieces", 1, F.size("found")), swapped, lambda a, b: F.concat(a["text"], b)), ""), F.element_at("pieces", -1)["text"])
    count = F.size(F.filter("found", lambda e: F.try_element_at("swap", e).isNotNull())) + F.aggregate("pieces", F.lit(0), lambda n, p: n + p["n"])
    new, n = F.when(F.col("swap").isNull(), F.col("text")).otherwise(joined), F.when(F.col("swap").isNull(), 0).otherwise(count).cast("long")
    both = both.select("row", new.alias("new"), n.alias("n")).union(base.where(~marked).select("row", F.col("text").alias("new"), F.lit(0).cast("long").alias("n")))
    columns = [F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in documents.columns if c != "n_entities"]
    return both.select(*columns, F.col("n").alias("n_entities"))


#: The key of the registered query; a deployment passes its own secret.
QUERY_KEY = "canopy"


def surrogate_report(documents: DataFrame) -> DataFrame:
    """The result of op10: every document with its rewritten text."""
    return replace_entities(documents.select("doc_id", "text"), QUERY_KEY)
