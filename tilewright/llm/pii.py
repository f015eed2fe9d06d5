"""PII surrogates: personal data and secrets replaced by keyed look-alikes.

A surrogate comes from a keyed permutation of all strings of the original's format:
same length, vowels for vowels, consonants for consonants, digits for digits, in the
same script. Permutations can't map two originals to one surrogate, so distinct entities
stay distinct and equal ones equal, across documents and runs, without a table of them;
:func:`distinct_surrogates` checks it on all data and moves those that meet all the same. First names are permuted within the list of
their script and gender. No surrogate equals its original.

Case, spacing and punctuation are put back as they were, so one number in two layouts,
or a name in capitals, keeps its coreference. Secrets hold their case, so theirs counts.

Every pattern takes time in proportion to the text: runs are taken whole, and what a run may
hold is bounded (an address by the standard's 64 and 255 characters, a word of a name by ``NAME_CHARS``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import as_bytes, bound_batches, fresh, slices, small_side, sole_cache, staged

KEY = b"tilewright demonstration key"
ROUNDS = 8

#: Letters that stand for one another.
ALPHABETS = (
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâäãèéêëìíîïòóôöõùúûü", "çñšžčř",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
    "āăąēĕėęěĩīĭįōŏőũūŭůűų", "ćĉċďđĝğġģĥħĵķĺļľłńņňŕŗśŝşţťŧŵźż",
)
#: Letters and digits of secrets, by what a block of one is made of: digits, lower or upper hexadecimal, anything else.
DIGITS, LOWER, CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SECRET_ALPHABETS = {"digits": (DIGITS,), "hex": (DIGITS + LOWER[:6],), "HEX": (DIGITS + CAPITALS[:6],), "other": (DIGITS, LOWER, CAPITALS)}
#: Characters of a secret that are permuted together.
BLOCK = 48

#: Country codes of two digits; those of one are 1 and 7, all others have three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

#: First names by script and gender.
FIRST_NAMES = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kevin George Edward Pierre Michel Philippe Alain Nicolas Laurent Hans Peter Klaus Wolfgang Stefan Andreas Jürgen José Antonio Manuel Francisco Javier Carlos Miguel Pedro Luis",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Marie Nathalie Isabelle Sylvie Catherine Françoise Ursula Monika Petra Sabine Renate Helga Karin María Carmen Josefa Isabel Dolores Pilar Teresa Lucía Rosa",
    ("cyrillic", "m"): "Александр Сергей Владимир Андрей Алексей Дмитрий Николай Иван Михаил Павел",
    ("cyrillic", "f"): "Елена Ольга Наталья Татьяна Ирина Светлана Мария Анна Людмила Екатерина",
    ("greek", "m"): "Γεώργιος Ιωάννης Κωνσταντίνος Δημήτριος Νικόλαος Παναγιώτης",
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική",
}
LISTS = {k: [n.lower() for n in v.split()] for k, v in FIRST_NAMES.items()}
PLACE = {name: (kind, k) for kind, names in LISTS.items() for k, name in enumerate(names)}

#: Titles that a name follows.
TITLES = "Mr Mrs Ms Miss Dr Prof Mme Mlle Monsieur Madame Herr Frau Señor Señora Sr Sra Don Doña г-н г-жа Κύριος Κυρία".split()

#: Capitals of the scripts above; those of Latin Extended-A by rule.
UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ" + "".join(c for c in map(chr, range(0x100, 0x180)) if c.isupper())
WORD = r"[^\W\d_]"
SURNAME = rf"[{UPPER}](?:{WORD}|['’-](?={WORD}))++"
#: Characters of the two sides of an address, and what a side must be; by the standard 64 and 255 characters at most.
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
LOCAL, DOMAIN = 64, 255
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
HOST = re.compile(rf"{LABEL}(?:\.{LABEL})+(?![A-Za-z0-9\-])")
#: Key formats that need no word before them.
BARE_KEY = re.compile(r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)([0-9A-Z]{16})|gh[pousr]_([A-Za-z0-9]{36}))(?![A-Za-z0-9])")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([a-z0-9_+/\-]{8,})")
LONG_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NUMERIC = re.compile(r"[+(\d][\d().\- ]*+")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NUMBER = re.compile(
    rf"(?<![\w.])(?P<ip>{OCTET}(?:\.{OCTET}){{3}})(?![\w]|\.\d)"
    r"|(?<!\w)(?P<phone>\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}([ .\-])\d{3}\3\d{4}|0\d{2,4}[ \-]\d{3,4}[ \-]\d{3,4})(?!\w)"
    r"|(?<!\w)(?P<ssn>\d{3}-\d{2}-\d{4})(?!\w)"
    r"|(?<![\w.])(?P<card>\d(?:[ \-]?\d){12,18})(?![\w]|\.\d)"
)
TITLE = rf"(?:{'|'.join(map(re.escape, TITLES))})"
#: A whole run of capitalised words, initials and titles; nothing behind it can make it fail.
RUN = re.compile(rf"(?<!\w)(?:{TITLE}\.?(?!\w)|{SURNAME}|(?:[{UPPER}]\.)++|[{UPPER}](?!\w))(?: (?:{TITLE}\.?(?!\w)|{SURNAME}|(?:[{UPPER}]\.)++|[{UPPER}](?!\w)))*+")
TITLED = re.compile(rf"{TITLE}\.?")
#: Characters of a word of a name at most; a longer one is none.
NAME_CHARS = 64
INITIAL = re.compile(rf"(?:[{UPPER}]\.)+|[{UPPER}]")
#: Words of a name after its listed first names at most, initials left out; words of a name in all.
LAST_NAMES, NAME_WORDS = 2, 8


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def iban(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


class Permuter:
    """Keyed permutations without fixed points."""

    def __init__(self, key: bytes):
        self.key = key[:64]
        self.string = lru_cache(100_000)(self._string)

    def _round(self, tweak: bytes, k: int, value: int, bits: int) -> int:
        data = b"%b|%d|%d" % (tweak, k, value)
        size = (bits + 7) // 8
        blocks = b"".join(blake2b(data + b"|%d" % i, key=self.key).digest() for i in range(-(-size // 64)))
        return int.from_bytes(blocks[:size], "big") & ((1 << bits) - 1)

    def _shuffle(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        """A Feistel network over the next power of four, walked until inside ``n``."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = b ^ self._round(tweak, k, a, half), a
                else:
                    a, b = b, a ^ self._round(tweak, k, b, half)
            x = a << half | b
            if x < n:
                return x

    def number(self, x: int, n: int, tweak: bytes) -> int:
        """A permutation of 0 to n - 1 that is one cycle, so no number is its own image if n > 1."""
        return self._shuffle((self._shuffle(x, n, tweak, False) + 1) % n, n, tweak, True)

    def _string(self, text: str, tweak: str, alphabets: tuple[str, ...] = ALPHABETS, valid: Callable[[str], bool] | None = None) -> str:
        """A string of the same format; with ``valid``, one that is so exactly if ``text`` is."""
        kinds = [next((a for a in alphabets if c in a), c) for c in text]
        n = 1
        for kind in kinds:
            n *= len(kind)
        if n == 1:
            return text
        salt, x = f"{tweak}|{'|'.join(kinds)}".encode(), 0
        for c, kind in zip(text, kinds):
            x = x * len(kind) + kind.index(c)
        while True:
            y = x = self.number(x, n, salt)
            out = []
            for kind in reversed(kinds):
                y, k = divmod(y, len(kind))
                out.append(kind[k])
            found = "".join(reversed(out))
            if valid is None or valid(found) == valid(text):
                return found


def like(original: str, replaced: str) -> str:
    """``replaced`` with capitals where ``original`` has them (all of them, if it has no others)."""
    if len(original) == len(replaced):
        return "".join(r.upper() if o.isupper() and len(r.upper()) == 1 else r for o, r in zip(original, replaced))
    if original.isupper():
        return replaced.upper()
    return replaced[:1].upper() + replaced[1:] if original[:1].isupper() else replaced


def spread(layout: str, signs: str, keep: Callable[[str], bool]) -> str:
    """``signs`` in place of those characters of ``layout`` that ``keep`` names."""
    rest = iter(signs)
    return "".join(next(rest) if keep(c) else c for c in layout)


def listed_name(word: str) -> bool:
    """Whether a word is a listed first name, or a double one that begins with one."""
    return word in PLACE or word.partition("-")[0] in PLACE


def names_in(parts: list[str], titled: bool) -> list[tuple[int, int]]:
    """First and last place of the names among capitalised words, without a title between them.

    One begins where a title stands before, and at each listed first name with a word behind it. Each ends in a word.
    """
    initial = [bool(INITIAL.fullmatch(p)) for p in parts]
    while initial and initial[-1]:
        initial.pop()
    parts = parts[: len(initial)]
    listed = [listed_name(p.lower()) for p in parts]
    out, k = [], 0
    while k < len(parts):
        if not (titled and k == 0 or listed[k] and k + 1 < len(parts)):
            k += 1
            continue
        end, rest = k + 1, LAST_NAMES
        while end < min(len(parts), k + NAME_WORDS):
            if initial[end]:
                pass
            elif listed[end] and (listed[end - 1] or initial[end - 1] and rest == LAST_NAMES):
                pass  # a further first name
            elif rest == 0 or listed[end] and end + 1 < len(parts):
                break
            else:
                rest -= 1
            end += 1
        while initial[end - 1] and end - 1 > k:
            end -= 1
        out.append((k, end - 1))
        k = end
    return out


def names(text: str) -> Iterator[tuple[int, int]]:
    """Begins and ends of the names of a text; each run of capitalised words is cut at titles and at words that are too long."""
    for m in RUN.finditer(text):
        parts, at, whole = m[0].split(" "), m.start(), m.end()
        begins: list[int] = []
        if text[whole : whole + 1].isalnum() or text[whole : whole + 1] == "_":
            parts.pop()  # the last word goes on with a digit
        for part in parts:
            begins.append(at)
            at += len(part) + 1
        low, titled = 0, False
        for k in range(len(parts) + 1):
            title = k < len(parts) and bool(TITLED.fullmatch(parts[k]))
            if k < len(parts) and not title and len(parts[k]) <= NAME_CHARS:
                continue
            for a, b in names_in(parts[low:k], titled):
                yield begins[low + a], begins[low + b] + len(parts[low + b])
            low, titled = k + 1, title


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Begins and ends of the addresses, from each ``@`` outwards."""
    at, end = text.find("@"), 0
    while at >= 0:
        begin, lowest = at, max(end, at - LOCAL - 1)
        while begin > lowest and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        size = at - begin
        while begin < at and text[begin] == ".":
            begin += 1
        host = HOST.match(text, at + 1, at + 2 + DOMAIN) if begin < at and size <= LOCAL and text[at - 1] != "." else None
        if host and host.end() - at - 1 <= DOMAIN:
            yield begin, host.end()
            end = host.end()
        at = text.find("@", max(at + 1, end))


def ipv6(text: str) -> IPv6Address | None:
    """An address of eight groups, or of three and more with a gap."""
    if ("::" in text and sum(map(bool, text.split(":"))) >= 3) or text.count(":") == 7:
        try:
            return IPv6Address(text)
        except AddressValueError:
            pass
    return None


def made_of(block: str) -> str:
    """The key of ``SECRET_ALPHABETS`` of a block."""
    if block.isascii() and block.isdigit():
        return "digits"
    return next((k for k in ("hex", "HEX") if set(block) <= set(SECRET_ALPHABETS[k][0])), "other")


class Surrogates:
    def __init__(self, key: bytes):
        self.permute = Permuter(key)

    def email(self, text: str) -> tuple[str, str]:
        """Local part and domain permuted; the domain ends in the reserved ``.example``."""
        low = text.lower()
        local, _, domain = low.rpartition("@")
        host, _, top = domain.rpartition(".")
        new = f"{self.permute.string(local, 'local')}@{self.permute.string(host, 'host')}.{top}"
        return low, like(text, new) + (".EXAMPLE" if text.isupper() else ".example")

    def ip(self, text: str) -> tuple[str, str]:
        if ":" in text:
            x = int(IPv6Address(text))
            return str(IPv6Address(x)), str(IPv6Address(self.permute.number(x, 1 << 128, b"ipv6")))
        x = 0
        for part in text.split("."):
            x = x << 8 | int(part)
        y = self.permute.number(x, 1 << 32, b"ip")
        return text, ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))

    def phone(self, text: str) -> tuple[str, str]:
        """The country code after a + stays, however it is set off; the number is permuted with those of that code and length."""
        digits = re.sub(r"\D", "", text)
        size = 0
        if text.startswith("+"):
            size = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
        code, rest = digits[:size], digits[size:]
        new = code + self.permute.string(rest, f"phone{code}")
        return f"{'+' if size else ''}{digits}", spread(text, new, str.isdigit)

    def ssn(self, text: str) -> tuple[str, str]:
        return text, self.permute.string(text, "ssn")

    def card(self, text: str) -> tuple[str, str]:
        digits = re.sub(r"\D", "", text)
        return digits, spread(text, self.permute.string(digits, "card", ALPHABETS, luhn), str.isdigit)

    def iban(self, text: str) -> tuple[str, str]:
        """The country stays; a valid check stays valid."""
        plain = text.replace(" ", "")
        country = plain[:2]
        letters = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        new = self.permute.string(plain[2:], "iban" + country, letters, _valid_iban(country))
        return plain, spread(text, country + new, str.isalnum)

    def secret(self, text: str) -> tuple[str, str]:
        """Block by block, each with what stood before it for a tweak and within the blocks that are made of the same."""
        out, before = [], blake2b(key=self.permute.key)
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            out.append(self.permute.string(block, f"secret{before.hexdigest()}" if at else "secret", SECRET_ALPHABETS[made_of(block)], made_of))
            before.update(block.encode())
        return text, "".join(out)

    def name(self, text: str) -> tuple[str, str]:
        """Known first names within their list, by script and gender; others letter by letter, never to a listed one."""
        out = []
        for part in text.split(" "):
            low = part.lower()
            if low in PLACE or low.partition("-")[0] in PLACE:
                out.append("-".join(self.word(x) for x in part.split("-")))
            else:
                out.append(self.word(part))
        return text.lower(), " ".join(out)

    def word(self, part: str) -> str:
        low = part.lower()
        if low in PLACE:
            kind, k = PLACE[low]
            return like_name(part, LISTS[kind][self.permute.number(k, len(LISTS[kind]), repr(kind).encode())])
        return like(part, self.permute.string(low, "name", ALPHABETS, listed_name))

    def entities(self, text: str) -> list[tuple[str, int, int, str, str]]:
        """(kind, begin, end, entity, surrogate) without overlaps, in order of the text."""
        found = [("email", *span) for span in emails(text)]
        found += [("secret", *m.span(1)) for m in SECRET.finditer(text)] + [("secret", *m.span()) for m in LONG_HEX.finditer(text)]
        found += [("secret", *m.span(m.lastindex)) for m in BARE_KEY.finditer(text)]
        found += [("iban", *m.span()) for m in IBAN.finditer(text)]
        found += [("ip", *m.span()) for m in IPV6.finditer(text) if ipv6(m[0])]
        for region in NUMERIC.finditer(text):
            if region.end() - region.start() < 7:
                continue
            # two signs more: what the patterns look ahead at
            each = NUMBER.finditer(text, region.start(), region.end() + 2)
            found += [(m.lastgroup or "phone", *m.span()) for m in each if m.lastgroup != "card" or luhn(re.sub(r"\D", "", m[0]))]
        found += [("name", *span) for span in names(text)]
        order = {"email": 0, "secret": 1, "iban": 2}
        found.sort(key=lambda x: (x[1], order.get(x[0], 3), -x[2]))
        out, end = [], 0
        for kind, a, b in found:
            if a >= end:
                out.append((kind, a, b, *getattr(self, kind)(text[a:b])))
                end = b
        return out

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int, str, str]]]:
        """The text with surrogates, and its entities."""
        found, out, at = self.entities(text), [], 0
        for _, a, b, _, new in found:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]) if found else text, found


@lru_cache(64)
def _valid_iban(country: str) -> Callable[[str], bool]:
    return lambda rest: iban(country + rest)


def like_name(original: str, name: str) -> str:
    if original.isupper():
        return name.upper()
    return name[:1].upper() + name[1:] if original[:1].isupper() else name


ENTITIES = "array<struct<kind:string,begin:int,end:int,entity:string,surrogate:string>>"
ENTITY_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("surrogate", pa.string())]))


def surrogates(docs: DataFrame, text_col: str = "text", key: bytes = KEY, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, else all) with the text replaced, and ``entities``.

    Card numbers are those of 13 to 19 digits with a valid check digit.
    ``entities`` has each one's kind, place in the old text (in characters), surrogate
    and a keyed hash that is equal for mentions of one entity. Null stays null, with no
    entities; texts without any stay as they are. Rows are independent, repeated ones
    alike. A column named ``entities`` is replaced. Empty in, empty out.
    """
    names = [c for c in (keep or docs.columns) if c != "entities"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", entities {ENTITIES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _maker(key)
        for batch in slices(batches, text_col):
            texts, entities = [], []
            for value in batch.column(text_col):
                text = value.as_py()
                if text is None:
                    texts.append(None)
                    entities.append([])
                    continue
                new, found = maker.replace(text.decode(errors="replace"))
                texts.append(new)
                entities.append([(k, a, b, blake2b(f"{k}|{e}".encode(), key=key[:64], digest_size=12).hexdigest(), s) for k, a, b, e, s in found])
            rows = [[dict(zip(("kind", "begin", "end", "entity", "surrogate"), x)) for x in e] for e in entities]
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, ENTITY_TYPE)], [*names, "entities"])

    columns = [as_bytes(text_col) if c == text_col else F.col(c) for c in names]
    return bound_batches(docs.select(*columns)).mapInArrow(run, schema)


@lru_cache(1)
def _made(key: bytes) -> Surrogates:
    return Surrogates(key)


def _maker(key: bytes) -> Surrogates:
    sole_cache("pii", _made.cache_clear)
    return _made(key)


def sign(kind: Column, surrogate: Column) -> Column:
    """What of a surrogate counts, as of an entity: no layout, and no case but a secret's."""
    bare = F.regexp_replace(surrogate, r"[ ().\-]", "")
    return F.when(kind.isin("phone", "card", "iban"), bare).when(kind == "secret", surrogate).otherwise(F.lower(surrogate))


def collisions(found: DataFrame) -> DataFrame:
    """``(kind, entity)`` of entities whose surrogate another entity has too, over all rows; of those that share one the first stays unnamed."""
    each = found.select(F.explode("entities").alias("e")).select("e.*")
    pairs = each.select("kind", F.sha2(sign(F.col("kind"), F.col("surrogate")), 256).alias("sign"), "entity").distinct()
    groups = pairs.groupBy("kind", "sign").agg(F.min("entity").alias("first"), F.max("entity").alias("last")).where("first <> last")
    shared = small_side(staged(groups.select(F.col("kind").alias("k"), F.col("sign").alias("s"), "first"), "shared_surrogates"))
    return pairs.join(shared, (F.col("kind") == F.col("k")) & (F.col("sign") == F.col("s"))).where(F.col("entity") != F.col("first")).select("kind", "entity").distinct()


#: Times that a surrogate which meets another's is moved on within its format, before it is told apart by a suffix.
MOVES = 8


def moved(found: DataFrame, who: DataFrame, text_col: str, key: bytes, turn: int) -> DataFrame:
    """``found`` with the surrogates of the entities ``who`` moved on, in their places; other rows and entities stay as they are.

    A move is what made the surrogate, done to the surrogate with a key of that turn. From turn ``MOVES`` on the
    entity's hash is put behind it.
    """
    names, row, moves_ = found.columns, fresh(found, "row"), fresh(found, "moves")
    r = f"{row}_"
    found = found.withColumn(row, F.struct(F.xxhash64("entities"), F.hash("entities")))
    entity = F.explode("entities").alias("e")
    who = small_side(staged(who.select(F.struct("kind", "entity").alias("who")), "moved_entities"))
    touched = found.select(F.col(row), entity).select(F.col(row).alias(r), F.struct("e.kind", "e.entity").alias("who")).distinct().join(who, "who")
    rows = small_side(staged(touched.groupBy(r).agg(F.collect_set("who.entity").alias(moves_)), "moved_rows"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _maker(blake2b(b"again|%d" % turn, key=key[:64]).digest())
        for batch in batches:
            texts, entities = [], []
            for text, own, moves in zip(*(batch.column(c).to_pylist() for c in (text_col, "entities", moves_))):
                if moves:
                    text, own = _moved(maker, text, own, set(moves), turn)
                texts.append(text)
                entities.append(own)
            columns = {text_col: pa.array(texts, pa.string()), "entities": pa.array(entities, ENTITY_TYPE)}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in names], names)

    joined = found.join(rows, F.col(row) == F.col(r), "left").select(*names, moves_)
    return bound_batches(joined).mapInArrow(run, schema)


def _moved(maker: Surrogates, text: str, entities: list[dict], moves: set[str], turn: int) -> tuple[str, list[dict]]:
    out, at, shift, changed = [], 0, 0, []
    for e in entities:
        begin = e["begin"] + shift
        end = begin + len(e["surrogate"])
        shift += len(e["surrogate"]) - (e["end"] - e["begin"])
        new = e["surrogate"]
        if e["entity"] in moves:
            new = getattr(maker, e["kind"])(new)[1] if turn < MOVES else f"{new}-{e['entity']}"
        out += [text[at:begin], new]
        at = end
        changed.append(e | {"surrogate": new})
    return "".join([*out, text[at:]]), changed


def distinct_surrogates(docs: DataFrame, text_col: str = "text", key: bytes = KEY, keep: list[str] | None = None) -> DataFrame:
    """:func:`surrogates`, written and checked over all rows: no surrogate stands for two entities.

    Where one does, all but the first of its entities are moved on, every mention alike, until none meet; other entities keep theirs.
    """
    found, turn = staged(surrogates(docs, text_col, key, keep), "surrogates"), 0
    while not (who := staged(collisions(found), "collisions")).isEmpty():
        turn += 1
        found = staged(moved(found, who, text_col, key, turn), "surrogates")
    return found
