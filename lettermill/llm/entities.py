"""Variant spellings of names, linked to the entries of an address book (problem 5).

Merge-and-rematch. Every entry starts as a profile of its own tokens. Written
names are compared with the profiles that share a block with them; names that
fit exactly one profile merge into it, and what they call its tokens, with the
initials they add, joins the profile. Spellings that names with one word left
open agree on join as well. The richer profiles enter blocking again with all
names still unlinked, until a round adds nothing.

A spelling keeps what it cost, and slips from it count on top, so that merges
can't drift from the book. Hence a slip of a word that may have two is not kept:
whatever it reaches is reached from the book's own form.

Tokens compare equal, with up to two typing slips, as initials, as
abbreviations, or as a learnt spelling. A name merges if all of its tokens fit
different tokens of the profile, given and family name among them, and no other
profile fits as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.split import split_items
from lettermill.llm import mojibake
from lettermill.llm.lookalike import canonical
from lettermill.session import cut, ship

FIELDS = ("from", "to", "cc")

# Words that go with a name without being part of it.
TITLES = frozenset("dr dra doctor sr sra srta mr mrs ms miss mx prof professor eng dipl ing herr frau mme mlle the don dona".split())
# Legal forms, written without dots.
FORMS = frozenset("gmbh ag kg sa sarl sas ltd ltda limited inc incorporated llc plc corp eireli mbh gesellschaft aktiengesellschaft limitada corporation".split())

#: Entries of the address book that one pass holds in memory. A longer book is worked through in parts.
BOOK_PART = 50_000
#: Rows that a spelling needs before a profile takes it over, and the share of its open names it must explain.
LEAST_SUPPORT, LEAST_SHARE = 2, 0.6
#: Learnt spellings and entries that the driver may hold; more is an error, never a cut.
MOST_SPELLINGS, MOST_ENTRIES = 200_000, 2_000_000
#: Letters of a word beyond which the blocks hold the two halves of its spelling instead of all deletions.
LONGEST_WORD = 30

_ADDRESS = re.compile(r"\s*<[^<>]*>\s*$", re.S)
_SPACES = re.compile(r"\s+")
_BARE = re.compile(r"^\S+@\S+$")
_NOTE = re.compile(r"\s*\([^()]*\)\s*$")
_DEPARTMENT = re.compile(r"\s+[-–—]\s+[^-–—]*$", re.S)
_CASE = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_FORM = re.compile(r"\b[Gg]?mbH\b")
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.){2,}(?=\s|$|[^\w])|\b[^\W\d_]/[^\W\d_]\b\.?|\b(?:[^\W\d_]\.){2,}[^\W\d_]\b")
#: Stands for a lost character: a letter that occurs in no name, so that it costs a slip.
_ANY = "ƣ"
_LOST = re.compile(f"{mojibake.LOST}+")
_TOKEN = re.compile(r"[^\W\d_]+")


def written_name(item: str) -> str:
    """The name of a mailbox as written, without the address and without quotes around it."""
    if len(item) > 500:
        item = _SPACES.sub(" ", item)  # the patterns below would look at a long run of blanks from each of its places
    name = _ADDRESS.sub("", item).strip()
    if len(name) > 1 and name[0] == name[-1] == '"':
        name = name[1:-1].replace('""', '"').strip()
    return "" if _BARE.match(name) else name


def fold(text: str) -> str:
    """Lower case letters without marks."""
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).casefold()


def _plain_umlauts(token: str) -> str:
    """A token with the two-letter spellings of umlauts reduced to one letter."""
    return token.replace("ae", "a").replace("oe", "o").replace("ue", "u")


@dataclass(frozen=True)
class Token:
    text: str
    kind: str  # word, initial, initials or short ("Chr.")


def tokens(name: str) -> list[Token]:
    """Tokens of a written name in order, without titles, legal forms, notes and departments."""
    if len(name) > 500:
        name = _SPACES.sub(" ", name)
    name = _DEPARTMENT.sub("", _NOTE.sub("", name))
    name = _FORM.sub(lambda m: m.group().lower(), _DOTTED.sub(lambda m: _squeeze(m.group()), name))
    spaced = " " in name.strip()
    if not spaced:
        name = name.replace("_", " ").replace(".", ". ")
    name = _CASE.sub(" ", name)
    shouting = name.upper() == name
    out = []
    for m in _TOKEN.finditer(name):
        t, dot = m.group(), name[m.end() : m.end() + 1] == "."
        f = fold(t)
        if f in FORMS or f in TITLES and not (f == "the" and dot):
            continue
        if len(f) == 1:
            out.append(Token(f, "initial"))
        elif len(t) <= 3 and t.isupper() and not shouting:
            out.append(Token(f, "initials"))
        elif dot and spaced:
            out.append(Token(f, "short"))
        else:
            out.append(Token(f, "word"))
    return out


def _squeeze(dotted: str) -> str:
    """Initials keep their dots; a dotted legal form loses them."""
    joined = dotted.replace(".", "").replace("/", "")
    return f" {joined} " if fold(joined) in FORMS else dotted.replace(".", ". ")


def distance(a: str, b: str, most: int) -> int:
    """Typing slips between two words (a swap of neighbours is one), or ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    two, one = [], [min(j, far) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        # only the band that few slips can reach
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row[j] = d
        if min(row) > most:
            return far
        two, one = one, row
    return min(one[-1], far)


def slips_allowed(length: int) -> int:
    """Short words must be exact."""
    return 0 if length < 4 else 1 if length < 6 else 2


def deletions(word: str, most: int) -> set[str]:
    """Keys of a word: two words within ``most`` slips share one.

    Of a word of usual length they are the word and what is left of it after up to ``most`` deletions. The
    deletions of a longer one grow with the square of its length, so its keys are those of ``_pieces``.
    """
    if len(word) > LONGEST_WORD - 2:
        return _pieces(word, most) if len(word) > LONGEST_WORD else _pieces(word, most) | _deletions(word, most)
    return _deletions(word, most)


def _pieces(word: str, most: int) -> set[str]:
    """Marked pieces of a long word, one of which ``most`` slips leave whole.

    A word is cut into 2 ``most`` + 1 pieces, since a swap may touch two; pieces of a partner, whose length
    differs by up to ``most`` and whose letters moved as far, are found at every cut of every such length.
    """
    out, parts = set(), 2 * most + 1
    for length in range(len(word) - most, len(word) + most + 1):
        for k in range(parts):
            begin, end = k * length // parts, (k + 1) * length // parts
            for shift in range(-most, most + 1):
                if begin + shift >= 0:
                    out.add(f"{length}/{k}/{word[begin + shift : end + shift]}")
    return out


def _deletions(word: str, most: int) -> set[str]:
    out = {word}
    for k in range(1, most + 1):
        if len(word) > k:
            for cut_at in combinations(range(len(word)), k):
                gone = set(cut_at)
                out.add("".join(c for i, c in enumerate(word) if i not in gone))
    return out


def slips(a: str, b: str) -> int | None:
    """Typing slips between two tokens, umlauts in either spelling; None beyond what their lengths allow."""
    best = None
    for x, y in {(a, b), (_plain_umlauts(a), _plain_umlauts(b))}:
        most = min(slips_allowed(len(x)), slips_allowed(len(y)))
        n = distance(x, y, most)
        if n <= most and (best is None or n < best):
            best = n
    return best


@dataclass
class Profile:
    entity_id: int
    name: str
    person: bool
    parts: list[str]
    weak: set[int] = field(default_factory=set)  # positions that can't carry a match alone: middle names, branches
    learnt: dict[str, dict[str, float]] = field(default_factory=dict)  # part to spellings of merged names and their cost
    middle: set[str] = field(default_factory=set)  # middle initials of merged names

    def take(self, part: str, text: str, cost: float) -> bool:
        """Take over what a merged name calls a part, or a middle initial for ''; whether that is new."""
        if not part:
            new = text not in self.middle
            self.middle.add(text)
            return new
        known = self.learnt.setdefault(part, {})
        new = cost < known.get(text, 9.0)
        if new:
            known[text] = cost
        return new


def profiles_of(book: Iterable[tuple[int, str, str]]) -> list[Profile]:
    """Profiles of (entity_id, kind, display_name)."""
    made = [Profile(e, n, k == "person", [t.text for t in tokens(n)]) for e, k, n in book if n and n.strip()]
    last = {p.parts[-1] for p in made if p.person and p.parts}
    middle: dict[str, int] = {}
    for p in made:
        if p.person and len(p.parts) > 2:
            middle[p.parts[1]] = middle.get(p.parts[1], 0) + 1
    for p in made:
        if p.person:
            p.weak = {0} | {i for i in range(1, len(p.parts) - 1) if middle.get(p.parts[i], 0) > 1 and p.parts[i] not in last}
        else:
            p.weak = set(range(1, len(p.parts)))
    return [p for p in made if p.parts]


class Matcher:
    """Profiles, their spellings and the blocks by which names find them."""

    def __init__(self, profiles: list[Profile], aliases: dict[str, dict[str, int]] | None = None, given: frozenset[str] | None = None) -> None:
        self.profiles, self.aliases = profiles, aliases or {}
        self.given = given if given is not None else {p.parts[0] for p in profiles if p.person}
        self.strong: dict[str, list[int]] = {}
        for k, p in enumerate(profiles):
            for i, part in enumerate(p.parts):
                if i not in p.weak:
                    for form in {part, *p.learnt.get(part, ())}:
                        self.strong.setdefault(form, []).append(k)
        self.block: dict[str, list[str]] = {}
        for part in self.strong:
            for form in {part, _plain_umlauts(part)}:
                for d in deletions(form, slips_allowed(len(form))):
                    self.block.setdefault(d, []).append(part)
        self.near: dict[str, list[tuple[str, int]]] = {}
        self.pairs: dict[tuple[str, str, str], float | None] = {}

    def reach(self, word: str) -> list[tuple[str, int]]:
        """Strong parts within the allowed slips of a word."""
        got = self.near.get(word)
        if got is None:
            if len(self.near) > 200_000:
                self.near.clear()
            found = {}
            for form in {word, _plain_umlauts(word)}:
                most = slips_allowed(len(form))
                for d in deletions(form, most):
                    for part in self.block.get(d, ()):
                        n = slips(word, part)
                        if n is not None and n < found.get(part, 9):
                            found[part] = n
            got = self.near[word] = sorted(found.items(), key=lambda x: (x[1], x[0]))
        return got

    def compare(self, t: Token, part: str, given: bool, person: bool) -> float | None:
        """Cost of reading a token as a part; None if it can't be."""
        key = (t.text, t.kind + ("g" if given else "p" if person else "o"), part)
        if key in self.pairs:
            return self.pairs[key]
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        cost = self.pairs[key] = self._compare(t, part, given, person)
        return cost

    def _compare(self, t: Token, part: str, given: bool, person: bool) -> float | None:
        text = t.text
        if text == part or _plain_umlauts(text) == _plain_umlauts(part):
            return 0.0
        if t.kind == "initial":
            return 0.5 if given and part[0] == text else None
        if (given or not person) and part in self.aliases.get(text, ()):
            return 0.3
        if t.kind == "short" and len(text) > 1 and part.startswith(text):
            return 0.3 if given or not person else None
        if not person and len(text) >= 3 and part[0] == text[0] and len(text) < len(part):
            if part.startswith(text):
                return 0.3
            rest = iter(part)
            if len(text) <= 5 and part[-1] == text[-1] and all(c in rest for c in text):
                return 0.4
        if given and text in self.given:
            return None  # another given name is no slip of this one
        if t.kind == "initials":
            return None
        n = slips(text, part)
        return None if n is None else float(n)

    def read(self, t: Token, p: Profile, i: int) -> float | None:
        """Cost of reading a token as a profile's part in the book's or a learnt spelling; None if it can't be."""
        given = p.person and (i == 0 or i in p.weak)
        best = self.compare(t, p.parts[i], given, p.person)
        for form, own in p.learnt.get(p.parts[i], {}).items():
            if t.kind == "initial":
                c = 0.5 if given and form[0] == t.text else None
            elif t.kind == "initials" or given and (t.text in self.given or t.text in self.aliases) and t.text != form:
                c = None
            else:
                n = slips(t.text, form)
                c = None if n is None else own + n
            if c is not None and (best is None or c < best):
                best = c
        return best

    def fit(self, name: list[Token], p: Profile) -> tuple[float, Token | None, str, str] | None:
        """(cost, token left open, part it would stand for, what a merge tells) of the best reading of a name as a profile.

        At most one word is left open. What a merge tells is "part:spelling:cost" by blanks, ":letter:0" for a middle initial.
        """
        left = set(range(len(p.parts)))
        cost, slips, strong, given, spare, told = 0.0, 0.0, False, not p.person, None, set()
        for t in sorted(name, key=lambda t: (t.kind != "word", -len(t.text))):
            if t.kind == "initials" and p.person:
                inner = [i for i in sorted(left) if i in p.weak or i + 1 < len(p.parts)]
                if len(t.text) <= len(inner) and all(p.parts[i][0] == c for i, c in zip(inner, t.text, strict=False)):
                    left -= set(inner[: len(t.text)])
                    cost, given = cost + 0.5, True
                    continue
                if 0 in left and t.text[0] == p.parts[0][0] and p.middle.issuperset(t.text[1:]):
                    left.discard(0)
                    cost, given = cost + 0.6, True
                    continue
            best = None
            for i in left:
                c = self.read(t, p, i)
                if c is not None and (best is None or (c, i) < best):
                    best = (c, i)
            if best is None:
                if t.kind == "initial" and p.person:
                    if t.text in p.middle:
                        cost += 0.55  # a middle initial that merged names have
                        continue
                    cost += 0.6  # one that the book doesn't have
                    if len(p.weak) > 1 and any(i in p.weak and i for i in left):
                        return None
                    told.add(f":{t.text}:0")
                    continue
                if t.kind == "word" and p.person and t.text[0] in p.middle and t.text not in self.strong:
                    cost += 0.6  # the middle name of an initial that merged names have
                    continue
                if spare is not None:
                    return None
                spare = t
                continue
            c, i = best
            left.discard(i)
            if c and t.kind in ("word", "short") and (c < 1 or c == 1 and slips_allowed(len(p.parts[i])) < 2):
                told.add(f"{p.parts[i]}:{t.text}:{c}")
            cost += c
            slips += c if c >= 1 else 0
            if i not in p.weak and c in (0.0, 1.0, 2.0) and t.kind in ("word", "short", "initials"):
                strong = True
            if i == 0 and p.person:
                given = True
        if not strong or slips > 2:
            return None
        if spare is not None:
            if p.person:
                return None if given else (cost + 5, spare, p.parts[0], "")
            return (cost + 5, spare, p.parts[min(left)], "") if len(left) == 1 and spare.kind == "word" else None
        if not given:
            return None
        return cost + 0.01 * len(left), None, "", " ".join(sorted(told))

    def match(self, name: str) -> list[tuple[float, int, str, str, str, str]]:
        """(cost, entity, open token, part it would stand for, what a merge tells, display name) of every profile that a name fits, best first."""
        toks = tokens(name)
        if not toks:
            return []
        found: dict[int, tuple[float, int, str, str, str, str]] = {}
        for t in toks:
            if t.kind == "word" or len(t.text) > 2:
                for part, _ in self.reach(t.text):
                    for k in self.strong[part]:
                        if k not in found:
                            p = self.profiles[k]
                            got = self.fit(toks, p)
                            if got is not None:
                                found[k] = (got[0], p.entity_id, got[1].text if got[1] else "", got[2], got[3], p.name)
        return sorted(found.values())


_NAMES = "seq bigint, field string, name string"
_FITS = "name string, entity_id bigint, cost double, token string, given string, told string, display string"


def written_names(rows: DataFrame, model: mojibake.Model, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(seq, field, name) of the names in mailbox fields, repaired and in canonical form."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for batch in batches:
            seqs = batch.column("seq").to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for f in fields:
                for seq, text in zip(seqs, batch.column(f).to_pylist(), strict=True):
                    if not text:
                        continue
                    mine = set()
                    for item in split_items(text):
                        name = written_name(item)
                        if name and not name.isascii():
                            clean = known.get(name)
                            if clean is None:
                                clean = canonical(m.repair(name) or _LOST.sub(_ANY, name))
                                if len(known) > 200_000:
                                    known.clear()
                                known[name] = clean
                            name = clean
                        if name and name not in mine:
                            mine.add(name)
                            out[0].append(seq)
                            out[1].append(f)
                            out[2].append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["seq", "field", "name"])

    return rows.where("seq is not null").select(F.col("seq").cast("long").alias("seq"), *[F.col(f"`{f}`") for f in fields]).mapInArrow(run, _NAMES)


def _fits(shared: Broadcast[list[list[Profile]]], place: int, aliases: dict[str, dict[str, int]]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = frozenset(p.parts[0] for profiles in shared.value for p in profiles if p.person)  # of the whole book
        matcher = Matcher(shared.value[place], aliases, given)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for name in batch.column("name").to_pylist():
                got = matcher.match(name)
                closed = [x for x in got if not x[2]]
                # of the closed readings the best and the next entity's tell whether it is alone; of the open ones the best count
                other = [x for x in closed if x[1] != closed[0][1]][:1]
                for cost, entity, token, part, told, display in closed[:1] + other if closed else [x for x in got if x[0] == got[0][0]]:
                    same = _ANY in name and re.fullmatch(re.escape(name).replace(_ANY, ".{1,2}"), display, re.I)
                    for k, v in enumerate((name, entity, cost, token, part, told, name if same else display)):
                        out[k].append(v)
            kinds = (pa.string(), pa.int64(), pa.float64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["name", "entity_id", "cost", "token", "given", "told", "display"])

    return run


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [t for name in batch.column("name").to_pylist() for t in {t.text for t in tokens(name)}]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["token"])


def _book_parts(book: DataFrame) -> list[list[Profile]]:
    rows = [(r[0], r[1], r[2]) for r in book.where("entity_id is not null and display_name is not null").select("entity_id", "kind", "display_name").distinct().orderBy("entity_id", "display_name").limit(MOST_ENTRIES + 1).toLocalIterator()]
    if len(rows) > MOST_ENTRIES:
        raise ValueError("the address book is longer than MOST_ENTRIES")
    made = profiles_of(rows)
    return [made[k : k + BOOK_PART] for k in range(0, len(made), BOOK_PART)]


def _enrich(parts: list[list[Profile]], merged: DataFrame) -> bool:
    """Let the profiles take over what the names merged into them tell; whether any of it is new."""
    told = merged.where("told <> ''").select("entity_id", F.explode(F.split("told", " ")).alias("told")).distinct().limit(MOST_SPELLINGS + 1).collect()
    if len(told) > MOST_SPELLINGS:
        raise ValueError("merged names tell more spellings than MOST_SPELLINGS")
    by_entity: dict[int, list[tuple[str, str, float]]] = {}
    for entity, one in told:
        part, text, cost = one.split(":")
        by_entity.setdefault(entity, []).append((part, text, float(cost)))
    new = [p.take(*x) for profiles in parts for p in profiles for x in by_entity.get(p.entity_id, ()) if not x[0] or x[0] in p.parts]
    return any(new)


def linked_names(names: DataFrame, book: DataFrame) -> DataFrame:
    """(name, entity_id) of the written names that stand for one entry in another spelling.

    ``names`` holds distinct names. Each round matches the names still unlinked against the profiles as they
    are now, then lets the profiles take over what merged names tell and the spellings that open names agree on.
    Every round but the last adds to the profiles, and what can be added is finite.
    """
    parts, aliases = _book_parts(book), {}
    if not parts:
        return names.select("name", F.lit(None).cast("bigint").alias("entity_id")).where("false")
    open_names, found = names, []
    counts = cut(names.mapInArrow(_token_batches, "token string").groupBy("token").agg(F.count("*").alias("n")))
    given = {p.parts[0] for profiles in parts for p in profiles if p.person}
    known = given | {x for profiles in parts for p in profiles if not p.person for x in p.parts}
    while True:
        fits = None
        book_now = names.sparkSession.sparkContext.broadcast(parts)
        for part in range(len(parts)):
            got = open_names.mapInArrow(_fits(book_now, part, aliases), _FITS)
            fits = got if fits is None else fits.unionByName(got)
        fits = cut(fits)
        closed = fits.where("token = ''")
        least = closed.groupBy("name").agg(F.min("cost").alias("least"), F.min_by(F.struct("entity_id", "display", "told"), "cost").alias("best"))
        alone = closed.join(least, "name").where("cost <= least + 1e-9").groupBy("name").agg(F.countDistinct("entity_id").alias("n"), F.first("best").alias("best")).where("n = 1")
        merged = cut(alone.select("name", "best.entity_id", "best.display", "best.told"))
        found.append(merged.drop("told"))
        still = fits.where("token <> ''").join(closed.select("name").distinct(), "name", "left_anti")
        # a spelling stands for a given name if that name is open to it wherever it occurs, and it is no name of its own
        by_given = still.groupBy("token", "given").agg(F.countDistinct("name").alias("k"), F.countDistinct("entity_id").alias("entities"))
        by_token = still.select("name", "token").distinct().groupBy("token").agg(F.count("*").alias("open"))
        # where several given names are as open to it, one that shares letters with the spelling counts more
        shared = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("token") - 2)), lambda i: F.contains("given", F.substr("token", i, F.lit(3)))) | F.startswith("given", F.substring("token", 1, 2))
        weighed = by_given.withColumn("w", F.col("k") * F.when(shared, 1.5).otherwise(1.0))
        ranked = weighed.groupBy("token").agg(F.max(F.struct("w", "k", "given", "entities")).alias("top"), F.sort_array(F.collect_list("w"), asc=False).alias("ws"))
        next_best = F.when(F.size("ws") > 1, F.col("ws")[1]).otherwise(0.0)
        sure = ranked.join(by_token, "token").join(counts, "token").where((F.col("open") >= LEAST_SUPPORT) & (F.col("top.k") >= 0.8 * F.col("open")) & (F.col("open") >= LEAST_SHARE * F.col("n")) & (next_best <= 0.7 * F.col("top.w")))
        learnt = sure.select("token", "top.given", "top.k", "top.entities").limit(MOST_SPELLINGS + 1).collect()
        if len(learnt) > MOST_SPELLINGS:
            raise ValueError("more spellings than MOST_SPELLINGS were learnt; raise LEAST_SUPPORT")
        # a word of one organisation's name may be another organisation's, so two must agree on it
        new = {r[0]: {r[1]: int(r[2])} for r in learnt if r[0] not in aliases and r[0] not in known and (r[1] in given or r[3] > 1)}
        if not _enrich(parts, merged) and not new:
            break
        aliases = aliases | new
        open_names = cut(open_names.join(merged.select("name"), "name", "left_anti"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.where(F.lower("name") != F.lower("display")).select("name", "entity_id")


def linked_rows(rows: DataFrame, book: DataFrame, model: mojibake.Model | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(seq, field, entity_id) of every row and field that names an entry of ``book`` in another spelling.

    A spelling counts as another if it differs in more than letter case and enclosing quotes; damage in the
    sense of the wrong encoding or look-alike letters is repaired first. Names that fit two entries equally
    well are linked to neither; addresses decide nothing. Null, empty and address-only items have no name; names
    and words may be of any length.
    Repeated rows give one row; an empty table or book gives none; other columns are ignored.
    """
    ship(rows.sparkSession)
    model = model or mojibake.learn(rows)
    names = cut(written_names(rows, model, fields))
    distinct = cut(names.select("name").distinct())
    linked = linked_names(distinct, book)
    return names.join(linked, "name").select("seq", "field", "entity_id").distinct()
