"""PII surrogates: entities found in texts get keyed, type-consistent replacements, by SQL functions alone.

Kinds: email, ip (v4), secret (hex keys, access keys), iban, phone (7 digits at least), card
(13 to 19 digits), ssn, and the given names and surnames of persons.  A person is found by
its context, that is after a form of address or words that announce a name ("my name is",
"Contact:"), or by a given name of the table followed by another name, in title or upper
case.  Other mentions of a name that is found so in a text are replaced in that text too.

An entity is its kind and its canonical form (digits of a number, lower case of the rest),
so mentions in other formats or cases, with or without a form of address, are the same entity
and get the same surrogate (coreference).  Gender is no part of it, but an attribute that
all mentions of a given name agree on by majority, from forms of address and the table.

A surrogate is drawn from SHA-256 of key, kind, canonical form and a nonce.  Names are made
of syllables of the same script, as long as the name, with endings of the gender (Greek names
and Cyrillic surnames keep their own last letters, which carry it).  Digits become digits; of
mail addresses and keys vowels become vowels and consonants consonants; a mail address goes to
the reserved domain `example`; a card number keeps whether its check digit is right.  Each
mention is written in its own format and case.

Collision check: a surrogate that equals another entity's, or any entity that occurs, is
drawn again with the next nonce (of entities with equal surrogates, all but the first in
order), until all differ.  Rounds work on the table of distinct entities, which is
distributed; after ROUNDS rounds a surrogate of any kind but an address (v4) grows by a
character or digit each round, so that no length is ever exhausted.

Scale: one regex pass over all texts, whose result is written with the rows; only rows with
mentions are split again and shuffled, by a row number.  An entity that a third of all rows
mention is a skewed join key of rows of a few words.

Edge cases: a null or empty text stays as it is; null doc_ids, repeated rows and extra
columns are kept (rows are joined by their own number, not by doc_id); a table without
rows or without mentions gives itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.llm._text import discard, stash

KEY = "relkit-surrogates"
ROUNDS = 6
#: Rounds after which IPv4 addresses, the one kind that can't grow, count as exhausted.
MOST_ROUNDS = 200

# Forms of address by gender, words that announce a name, and common given names by gender.
FORMS_M = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин"]
FORMS_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа"]
FORMS = ["Dr", "Prof", "Доктор"]
CUES = ["my name is", "My name is", "contact", "Contact", "Name", "signed", "Signed", "written by", "Author", "Patient", "regards", "Regards", "sincerely", "Sincerely", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "Ansprechpartner", "gez.", "je m'appelle", "Je m'appelle", "signé", "Nom", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "Nombre", "Firmado", "меня зовут", "Меня зовут", "Имя"]
GIVEN_M = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Andrew", "Paul", "Steven", "George", "Edward", "Brian", "Kevin", "Peter", "Henry", "Frank", "Jack", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Andreas", "Uwe", "Dieter", "Pierre", "Jean", "Jacques", "Michel", "Philippe", "Nicolas", "Louis", "François", "José", "Juan", "Carlos", "Luis", "Miguel", "Javier", "Pedro", "Manuel", "Иван", "Сергей", "Алексей", "Дмитрий", "Андрей", "Николай", "Михаил", "Владимир"]
GIVEN_F = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Alice", "Emily", "Emma", "Jane", "Margaret", "Nancy", "Laura", "Helen", "Ruth", "Julia", "Anna", "Maria", "Ursula", "Monika", "Petra", "Sabine", "Claudia", "Ingrid", "Heike", "Marie", "Sophie", "Camille", "Isabelle", "Nathalie", "Chloé", "Hélène", "Carmen", "Lucía", "Ana", "Isabel", "Pilar", "Elena", "Marta", "Мария", "Ольга", "Елена", "Анна", "Наталья", "Татьяна", "Ирина"]

# Every alternative but the last begins where no letter or digit stands before; cheap looks
# ahead and possessive repeats keep the pattern from trying much at each of those places.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_EMAIL = r"(?<![._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_IP = rf"(?=\d)(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
_SECRET = r"(?:(?=[0-9a-f]{8})[0-9a-f]{32,64}|(?=[0-9A-F]{8})[0-9A-F]{32,64}|(?=[Ags])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}))(?![A-Za-z0-9])"
_IBAN = r"(?=[A-Z]{2}\d)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_PHONE = r"(?<![\w+])\+(?=(?:[ .()-]{0,2}\d){7})\d{1,3}(?:[ .-]{0,1}\(?\d{1,4}\)?){2,5}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.])0\d(?:[ .-]\d{2}){4}(?!\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_CARD = r"(?=\d)(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
_NAME = r"\p{Lu}(?:\p{Ll}+|\p{Lu}+)(?:[-'’]\p{Lu}\p{L}+)?"
_INITIAL = r"(?: \p{Lu}\.)?"
# at a capital letter: after words that announce a name, at a form of address, or at a given name of the table
_CUED = rf"(?<=(?:{'|'.join(x.replace('.', '[.]') for x in CUES)})[:,]? )(?!(?:Sir|Madam|All|Team)\b){_NAME}(?:{_INITIAL} {_NAME}){{0,2}}"
_PERSON = rf"(?=\p{{Lu}})(?:(?iu:{'|'.join(FORMS_M + FORMS_F + FORMS)})\.? {_NAME}(?:{_INITIAL} {_NAME})?|(?iu:{'|'.join(GIVEN_M + GIVEN_F)}){_INITIAL} {_NAME}|{_CUED})(?!\p{{L}})"
PATTERN = rf"(?<![\p{{L}}\p{{N}}])(?:{_EMAIL}|{_IP}|{_SECRET}|{_IBAN}|(?=[\d+(])(?:{_PHONE}|{_SSN})|{_PERSON})|{_CARD}"

_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιο"}
_CONSONANTS = {"latin": "bcdfghjklmnprstvz", "cyrillic": "бвгдзклмнпрст", "greek": "βγδκλμνπρστ"}
_SCRIPTS = {"latin": "[a-z]", "cyrillic": "[а-яё]", "greek": "[α-ω]"}
_MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçß"
_MARKED_PLAIN = "aaaaaaeeeeiiiiooooouuuuncs"
#: Endings of names by script, kind and gender; a syllable before them ends as they need it.
_ENDINGS = {
    ("latin", "given", "m"): ["o", "an", "en", "us", "er", "n", "ric", "lo"],
    ("latin", "given", "f"): ["a", "ia", "ina", "ela", "na", "la", "ra"],
    ("latin", "given", ""): ["e", "i", "in", "n", "l", "ri"],
    ("latin", "surname", ""): ["er", "en", "ov", "ez", "ard", "in", "n", "son", "man", "ley", "r"],
    ("cyrillic", "given", "m"): ["ан", "ей", "ил", "н", "лав", "р"],
    ("cyrillic", "given", "f"): ["а", "ия", "ина", "на", "ла", "ша"],
    ("cyrillic", "given", ""): ["и", "ли"],
}
#: A text at the edges of its words, to look for names one by one.
_EDGES = r"(?<![\p{L}'’-])(?=\p{L})|(?<=\p{L})(?![\p{L}'’-])"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _form_regex(forms: list[str]) -> str:
    return _sql(rf"^(?iu:{'|'.join(forms)})\.?$")


#: The kind of a whole mention, from the mention itself.
_KIND = f"""CASE WHEN x LIKE '%@%' THEN 'email' WHEN x RLIKE {_sql('^' + _IP + '$')} THEN 'ip' WHEN x RLIKE {_sql('^(?:' + _SECRET + ')$')} THEN 'secret'
 WHEN x RLIKE {_sql('^' + _IBAN + '$')} THEN 'iban' WHEN x RLIKE {_sql('^(?:' + _PHONE + ')$')} THEN 'phone' WHEN x RLIKE {_sql('^' + _SSN + '$')} THEN 'ssn'
 WHEN x RLIKE '^[0-9]' THEN 'card' ELSE 'person' END"""
_DIGITS = "('phone', 'ssn', 'card', 'ip')"


def _parts(mention: str) -> str:
    """The replaceable parts of a mention: array of (kind, gender, said); forms of address and initials have the kind ''."""
    words = f"split({mention}, ' ')"
    form, form_m, form_f = (_form_regex(x) for x in (FORMS_M + FORMS_F + FORMS, FORMS_M, FORMS_F))
    known_m, known_f = (_list([x.lower() for x in names]) for names in (GIVEN_M, GIVEN_F))
    gender = f"CASE WHEN {words}[0] RLIKE {form_m} THEN 'm' WHEN {words}[0] RLIKE {form_f} THEN 'f' WHEN array_contains({known_m}, lower(w)) THEN 'm' WHEN array_contains({known_f}, lower(w)) THEN 'f' ELSE '' END"
    given = f"array_contains({known_m}, lower(w)) OR array_contains({known_f}, lower(w))"
    # the last of several names is the surname; a single one is it after a form of address, if it is no known given name
    kind = f"CASE WHEN i = 0 AND w RLIKE {form} OR w RLIKE '^\\\\p{{Lu}}[.]$' THEN '' WHEN i < size({words}) - 1 OR size({words}) = 1 OR i = 1 AND {words}[0] RLIKE {form} AND ({given}) THEN 'given' ELSE 'surname' END"
    whole = _KIND.replace("x ", f"{mention} ")
    return f"CASE WHEN {whole} = 'person' THEN transform({words}, (w, i) -> named_struct('kind', {kind}, 'gender', {gender}, 'said', w)) ELSE array(named_struct('kind', {whole}, 'gender', '', 'said', {mention})) END"


def _list(values: list[str]) -> str:
    return f"array({', '.join(map(_sql, values))})"


def _canonical(kind: str, said: str) -> str:
    return f"CASE WHEN {kind} IN ('phone', 'ssn', 'card') THEN regexp_replace({said}, '[^0-9]', '') WHEN {kind} = 'iban' THEN lower(replace({said}, ' ', '')) ELSE lower({said}) END"


def _check_digit(number: str) -> str:
    """The last digit that a card number of those digits ought to have."""
    digit = f"cast(substr({number}, j, 1) as int)"
    return f"(10 - aggregate(sequence(1, length({number}) - 1), 0, (a, j) -> a + CASE WHEN (length({number}) - j) % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END) % 10) % 10"


def _draw(key: str) -> tuple[str, str]:
    """Expressions over kind, canonical, gender and nonce: the characters drawn, and (over `drawn` too) the surrogate."""
    seed = f"concat({_sql(key)}, '|', kind, '|', canonical, '|', nonce)"
    hashed = f"concat(sha2({seed}, 256), sha2(concat({seed}, '|'), 256))"
    plain = f"translate(canonical, {_sql(_MARKED)}, {_sql(_MARKED_PLAIN)})"
    value = f"cast(conv(substr({hashed}, (i % 32) * 4 + 1, 4), 16, 10) as int)"
    more = f"greatest(0, nonce - {ROUNDS})"

    def pick(letters: str) -> str:
        return f"substr({_sql(letters)}, {value} % {len(letters)} + 1, 1)"

    hexes = f"CASE WHEN kind = 'secret' AND canonical RLIKE '^[0-9a-f]+$' THEN {pick('0123456789abcdef')}"
    country = "WHEN kind = 'phone' AND i = 0 OR kind = 'iban' AND i < 2 THEN c"
    letters = " ".join(f"WHEN instr({_sql(_VOWELS[s])}, c) > 0 THEN {pick(_VOWELS[s])} WHEN c RLIKE {_sql(span)} THEN {pick(_CONSONANTS[s])}" for s, span in _SCRIPTS.items())
    chars = f"array_join(transform(filter(split({plain}, ''), c -> c <> ''), (c, i) -> {hexes} {country} WHEN c RLIKE '[0-9]' THEN {pick('0123456789')} {letters} ELSE c END), '')"
    # names: consonant and vowel in turns, marks and hyphens where they are, as long as the name or longer
    size = f"(length(canonical) + {more})"
    script = "CASE " + " ".join(f"WHEN {plain} RLIKE {_sql('^' + span)} THEN '{s}'" for s, span in _SCRIPTS.items()) + " ELSE 'latin' END"
    spoken = " ".join(f"WHEN {script} = '{s}' THEN CASE WHEN i % 2 = 0 THEN {pick(_CONSONANTS[s])} ELSE {pick(_VOWELS[s])} END" for s in _SCRIPTS)
    name = f"array_join(transform(sequence(0, {size} - 1), i -> CASE WHEN substr(canonical, i + 1, 1) RLIKE '[^\\\\p{{L}}]' THEN substr(canonical, i + 1, 1) {spoken} END), '')"
    chars = f"CASE WHEN kind IN ('given', 'surname') THEN {name} ELSE {chars} END"
    endings = "CASE " + " ".join(f"WHEN kind = '{kind}' AND {script} = '{s}'{f' AND gender = {_sql(g)}' if g else ''} THEN {_list(ends)}" for (s, kind, g), ends in _ENDINGS.items()) + " WHEN length(canonical) > 3 THEN array(right(canonical, 2)) ELSE array('') END"
    vowels = _sql(f"^[{''.join(_VOWELS.values())}ия]")
    # an ending must leave a syllable before it and go on from it; kept endings may not
    fit = f"filter({endings}, e -> length(e) < {size} AND (({size} - length(e)) % 2 = 1) = (e RLIKE {vowels}))"
    ending = f"CASE WHEN size({fit}) > 0 THEN {fit}[cast(conv(substr({hashed}, 121, 4), 16, 10) as int) % size({fit})] WHEN {script} <> 'latin' THEN {endings}[0] ELSE '' END"
    named = f"concat(substr(drawn, 1, length(drawn) - length({ending})), {ending})"
    grown = f"CASE WHEN {more} > 0 THEN substr(translate(sha2({seed}, 256), '0123456789', 'ghklmnprst'), 1, {more}) ELSE '' END"
    digits = f"CASE WHEN {more} > 0 THEN substr(translate(sha2({seed}, 256), 'abcdef', '012345'), 1, {more}) ELSE '' END"
    octets = " , '.' , ".join(f"1 + cast(conv(substr({hashed}, {4 * j + 1}, 4), 16, 10) as int) % 254" for j in range(4))
    # mail: the local part and domain labels in kind, then the reserved top-level domain
    mail = f"concat(regexp_extract(drawn, '^[^@]*', 0), {grown}, '@', regexp_extract(drawn, '@(.*)\\\\.[^.]*$', 1), '.example')"
    card = f"concat(substr(drawn, 1, length(drawn) - 1), ({_check_digit('drawn')} + CASE WHEN {_check_digit('canonical')} = cast(right(canonical, 1) as int) THEN 0 ELSE 1 END) % 10, {digits})"
    return chars, f"CASE WHEN kind = 'ip' THEN concat({octets}) WHEN kind = 'email' THEN {mail} WHEN kind = 'card' THEN {card} WHEN kind IN ('phone', 'ssn') THEN concat(drawn, {digits}) WHEN kind IN ('given', 'surname') THEN {named} ELSE concat(drawn, {grown}) END"


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    chars, final = _draw(key)
    return entities.withColumn("drawn", F.expr(chars)).withColumn("surrogate", F.expr(final)).drop("drawn")


def surrogates(entities: DataFrame, *, key: str = KEY) -> DataFrame:
    """(kind, canonical, surrogate) of distinct entities(kind, canonical, and maybe gender): no two of a kind alike, none that occurs."""
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(""))
    known = entities.select("kind", F.col("canonical").alias("surrogate")).distinct().withColumn("occurs", F.lit(True))
    now = stash(_drawn(entities.withColumn("nonce", F.lit(0)), key), "surrogates")
    for _ in range(MOST_ROUNDS):
        first = now.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"), F.count("*").alias("n"))
        clash = now.join(first.where("n > 1").drop("n"), ["kind", "surrogate"], "left").join(known, ["kind", "surrogate"], "left")
        again = clash.withColumn("again", F.expr("coalesce(occurs, false) OR (first IS NOT NULL AND first <> canonical)"))
        again = stash(again.select("kind", "canonical", "gender", "nonce", "surrogate", "again"), "surrogates-checked")
        if again.where("again").isEmpty():
            discard(again)
            return now.select("kind", "canonical", "surrogate")
        moved = _drawn(again.where("again").select("kind", "canonical", "gender", (F.col("nonce") + 1).alias("nonce")), key)
        before, now = now, stash(again.where("not again").select(moved.columns).union(moved), "surrogates")
        discard(before, again)
    raise ValueError("no free IPv4 addresses are left as surrogates")


def _agreed() -> list:
    """The gender that most mentions of an entity have, as aggregates."""
    count = lambda g: F.sum(F.when(F.col("gender") == g, 1).otherwise(0))
    return [F.when(count("m") > count("f"), "m").when(count("f") > 0, "f").otherwise("").alias("gender")]


def _name_cased(said: str, drawn: str) -> str:
    """A drawn name in the case of what was said."""
    title = f"array_join(transform(split({drawn}, '-'), y -> concat(upper(substr(y, 1, 1)), substr(y, 2))), '-')"
    return f"CASE WHEN length({said}) > 1 AND {said} = upper({said}) THEN upper({drawn}) ELSE {title} END"


def _rendered(mention: str) -> str:
    """A mention with each part replaced by way of the map `known`, in the mention's own format and case."""
    drawn = f"try_element_at(known, concat(p.kind, '|', {_canonical('p.kind', 'p.said')}))"
    fill = f"aggregate(split(p.said, ''), named_struct('out', '', 'k', 1), (a, c) -> CASE WHEN c RLIKE '[0-9A-Za-z]' THEN named_struct('out', concat(a.out, substr({drawn}, a.k, 1)), 'k', a.k + 1) ELSE named_struct('out', concat(a.out, c), 'k', a.k) END, a -> a.out)"
    cased = f"CASE WHEN p.kind IN ('given', 'surname') THEN {_name_cased('p.said', drawn)} WHEN p.said = upper(p.said) THEN upper({drawn}) ELSE {drawn} END"
    digits = "length(regexp_replace(p.said, '[^0-9]', ''))"
    one = f"CASE WHEN p.kind = '' THEN p.said WHEN p.kind IN ('phone', 'ssn', 'card') THEN concat({fill}, substr({drawn}, {digits} + 1)) WHEN p.kind = 'iban' THEN concat(upper({fill}), upper(substr({drawn}, length(replace(p.said, ' ', '')) + 1))) ELSE {cased} END"
    return f"array_join(transform({_parts(mention)}, p -> {one}), ' ')"


def replace(docs: DataFrame, *, text: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """docs with every entity in `text` replaced; `count` names a column for the number of mentions."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(whole.alias("row"), F.col(text).alias("text"))
    found = rows.withColumn("mentions", F.coalesce(F.expr(f"regexp_extract_all(text, {_sql(PATTERN)}, 0)"), F.array().cast("array<string>")))
    found = stash(found.drop("text").withColumn("id", F.monotonically_increasing_id()), "mentions")
    hit = found.where("size(mentions) > 0").withColumn("text", F.col(f"row.`{text}`"))
    parts = hit.select("id", F.explode(F.array_distinct("mentions")).alias("m")).select("id", F.explode(F.expr(_parts("m"))).alias("p")).where("p.kind <> ''")
    own = parts.groupBy("id", "p.kind", F.expr(_canonical("p.kind", "p.said")).alias("canonical")).agg(F.max("p.gender").alias("gender"))
    own = stash(own, "named")
    given = surrogates(stash(own.groupBy("kind", "canonical").agg(*_agreed()), "entities"), key=key)
    known = own.join(given, ["kind", "canonical"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canonical"), "surrogate"))).alias("known"))
    gaps = f"split(text, {_sql(PATTERN)}, -1)"
    # names that were found in this text, wherever else in it they stand
    again = "coalesce(try_element_at(known, concat('surname|', lower(w))), try_element_at(known, concat('given|', lower(w))))"
    bare = f"array_join(transform(split(g, {_sql(_EDGES)}, -1), w -> CASE WHEN w RLIKE '^\\\\p{{Lu}}' THEN coalesce({_name_cased('w', again)}, w) ELSE w END), '')"
    names = "exists(map_keys(known), k -> k LIKE 'surname|%' OR k LIKE 'given|%')"
    # gaps and mentions take turns: one gap more than mentions
    written = f"array_join(transform({gaps}, (g, i) -> concat(CASE WHEN {names} THEN {bare} ELSE g END, coalesce(try_element_at(shown, i + 1), ''))), '')"
    done = hit.join(known, "id").withColumn("shown", F.expr(f"transform(mentions, m -> {_rendered('m')})"))
    done = done.select(F.col("row").withField(f"`{text}`", F.expr(written)).alias("row"), F.size("mentions").cast("bigint").alias("n"))
    clean = found.where("size(mentions) = 0").select("row", F.lit(0).cast("bigint").alias("n"))
    out = clean.union(done)
    return out.select("row.*", F.col("n").alias(count)) if count else out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs, count="n_entities")
