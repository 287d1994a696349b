"""Spellings of one person or group linked: suffix blocking, then longest common subsequence.

A spelling is taken apart into a core (surname, band or stage name) and its other words (given name,
kind of ensemble, partner band).  Which words are which is learned from the table itself: a word that
stands beside many unlike words is an ordinary one, so the rarest word is the core.  All suffixes of
the core above a minimum length are indexed, read from either end so that a slip near the end is
survived; they are refined with the other words' first letters and the core's length, and only refined
keys that are still overly common are discarded.  Suffixes of half the core are never discarded: one
slip leaves one of them whole.  Pairs that share a key are compared by the ratio of their cores'
longest common subsequence and by whether their other words can stand for each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanline.session import cut

# Given names with what their bearers are commonly called, from general knowledge of several languages.
NICKNAMES = {
    "abigail": "abby abbie gail", "abraham": "abe", "agnes": "aggie", "albert": "al bert bertie", "alexander": "alex al sandy lex sasha xander", "alexandra": "alex sandra sasha lexi",
    "alfred": "al alf fred", "amanda": "mandy", "andrew": "andy drew", "angela": "angie", "ann": "annie nan nancy", "anthony": "tony", "antonio": "tonio toni", "archibald": "archie",
    "arthur": "art artie", "barbara": "barb babs barbie", "bartholomew": "bart", "beatrice": "bea trixie", "benjamin": "ben benny benji", "bernard": "bernie", "calvin": "cal", "carolina": "caro lina",
    "caroline": "carrie caro", "catherine": "cathy cate kate kitty", "cecilia": "cece cissy", "charles": "charlie chuck chas", "charlotte": "lottie charlie lotte", "christina": "chris tina chrissy",
    "christopher": "chris kit topher", "clarence": "clary", "clifford": "cliff", "constance": "connie", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie debby",
    "dolores": "lola", "dominic": "dom nick", "donald": "don donnie", "dorothy": "dot dottie dolly", "douglas": "doug", "edmund": "ed eddie ned ted", "edward": "ed eddie ted teddy ned",
    "edwin": "ed eddie", "eleanor": "ellie nell nora lenny", "elizabeth": "liz lizzie beth betty bess eliza libby lisa", "emily": "em emmy", "emma": "em emmy", "ernest": "ernie", "eugene": "gene",
    "evelyn": "evie", "florence": "flo florrie", "frances": "fran frannie", "francis": "frank", "francisco": "paco pancho kiko", "franklin": "frank", "frederick": "fred freddie freddy fritz",
    "gabriel": "gabe", "geoffrey": "geoff jeff", "george": "georgie", "gerald": "gerry jerry", "gilbert": "gil bert", "giovanni": "gianni vanni", "giuseppe": "beppe pino", "gregory": "greg",
    "harold": "harry hal", "helen": "nell nellie", "henry": "harry hank hal", "herbert": "herb bert", "hermann": "manni", "hugh": "hughie", "ignacio": "nacho", "isaac": "ike zack", "isabella": "bella izzy isa",
    "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie", "jane": "janie jenny", "jeffrey": "jeff", "jennifer": "jen jenny jenna", "jessica": "jess jessie", "johann": "hans hannes",
    "john": "jack johnny jon", "jonathan": "jon jonny nathan", "jose": "pepe", "joseph": "joe joey jo", "josephine": "jo josie", "joshua": "josh", "judith": "judy", "julia": "julie jules",
    "katherine": "kate kathy katie kit kitty kat", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo", "leopold": "leo poldi", "lillian": "lil lily", "louis": "lou louie",
    "louise": "lou lulu", "lucille": "lucy", "madeleine": "maddie", "manuel": "manolo manny", "margaret": "maggie meg peggy madge greta rita", "maria": "mia mitzi", "martha": "marty mattie", "martin": "marty",
    "mary": "molly polly mae", "matilda": "tilly mattie", "matthew": "matt", "maximilian": "max maxi", "melissa": "mel missy", "michael": "mike mick mickey mikey", "mikhail": "misha", "mildred": "millie",
    "nathaniel": "nate nat", "nicholas": "nick nicky nico", "oliver": "ollie", "olivia": "liv livvy", "oscar": "ozzie", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy",
    "penelope": "penny", "peter": "pete", "philip": "phil pip", "priscilla": "cilla", "prudence": "prue", "rafael": "rafa", "raymond": "ray", "rebecca": "becca becky", "reginald": "reg reggie",
    "richard": "dick rick rich ricky richie", "robert": "bob bobby rob robbie bert", "roderick": "rod", "rodrigo": "rigo", "roger": "rodge", "ronald": "ron ronnie", "rosemary": "rosie", "rudolf": "rudi",
    "russell": "russ", "samantha": "sam sammy", "samuel": "sam sammy", "sarah": "sally sadie", "sebastian": "seb basti", "sergei": "seryozha", "simon": "si", "stanley": "stan", "stephanie": "steph",
    "stephen": "steve stevie", "susan": "sue susie", "susannah": "sue susie suzy", "sylvester": "sly", "tatiana": "tanya", "teresa": "terry tess tessa", "terence": "terry", "theodore": "ted teddy theo",
    "thomas": "tom tommy", "timothy": "tim timmy", "valentina": "val tina", "valerie": "val", "veronica": "ronnie vera", "victor": "vic", "victoria": "vicky tori vic", "vincent": "vince vinny",
    "vladimir": "vova volodya", "walter": "walt wally", "wilhelm": "willi", "william": "bill billy will willy liam", "winifred": "winnie", "yevgeny": "zhenya", "zachary": "zach zack",
}
# Words that join names, that stand before them, and that may be left out.
AND = {"&", "and", "n", "w", "+", "with", "und", "et", "y"}
ARTICLES = {"the", "thee"}
TITLES = {"dj", "of"}
MIN_SUFFIX = 3
MIN_RATIO = 0.7
#: A word is ordinary when it stands beside words of at least so many different beginnings ...
SPREAD = 3
#: ... and is at least this share of all words, so that there are at most ``1 / SHARE`` of them at any size.
SHARE = 0.0002
#: Of two ordinary words one may be a slip of the other if it stands beside so many times less often.
RARER = 5
#: Refined keys of short suffixes that more nodes than this have are overly common.
COMMON_KEY = 50


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("đ", "d").replace("æ", "ae"))
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


@lru_cache(maxsize=1 << 16)
def distance(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours counting as one."""
    if a == b:
        return 0
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(now[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, last = last, now
    return last[-1]


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence against both lengths."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


@lru_cache(maxsize=1 << 16)
def smooth(word: str) -> str:
    """A word without the slips that spelling by ear makes: y for i, doubled letters, z for a final s."""
    word = re.sub(r"(.)\1+", r"\1", word.replace("y", "i"))
    return word[:-1] + "s" if word.endswith("z") and len(word) > 4 else word


def alike(a: str, b: str) -> bool:
    """Whether two cores are one: a long common subsequence and few edits for their length."""
    if a == b:
        return True
    shortest = min(len(a), len(b))
    if shortest < 4 or abs(len(a) - len(b)) > 2 or ratio(a, b) < MIN_RATIO:
        return False
    return distance(a, b) <= (1 if shortest < 7 else 2)


def _gone(word: str) -> set[str]:
    """A word and what is left of it without one letter, as keys for words one or two edits away."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _shortens(token: str, word: str) -> bool:
    """Whether a token abbreviates a word: the same first letter, and its letters in order."""
    if not token or token[0] != word[0] or len(token) >= len(word):
        return False
    rest = iter(word)
    return all(c in rest for c in token)


_CALLED: dict[str, frozenset[str]] = {}
for _full, _short in NICKNAMES.items():
    for _name in [_full, *_short.split()]:
        _CALLED[smooth(_name)] = _CALLED.get(smooth(_name), frozenset()) | {_full}


@lru_cache(maxsize=1 << 16)
def lex(artist: str) -> tuple[tuple[str, ...], frozenset[str], bool, frozenset[str], tuple[str, ...]]:
    """A spelling's words in order (joining signs and articles too), those with a dot, whether there is a comma, those after an article, and quoted words."""
    quoted = tuple(smooth(w) for part in re.findall(r"[“\"„«]([^”\"“»]*)[”\"“»]", artist) for w in re.findall(r"[^\W\d_]+", fold(part)))
    text = re.sub(r"[“\"„«][^”\"“»]*[”\"“»]", " ", artist)
    text = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-ZÀ-ÞŠŽČŘ])", " ", unicodedata.normalize("NFC", text))
    text = re.sub(r"\bd\.\s?j\.?(?=\W|$)|\bdee\s?jay\b", "dj", fold(text))
    dotted = frozenset(smooth(w) for w in re.findall(r"([^\W\d_]+)\.", text))
    tokens = re.findall(r"[^\W_]+|[&+]", re.sub(r"w/", " w ", text).replace("'", "").replace("’", ""))
    led = frozenset(smooth(b) for a, b in zip(tokens, tokens[1:]) if a in ARTICLES) | ({smooth(tokens[0])} if "," in text and tokens and tokens[-1] in ARTICLES else set())
    return tuple(t if t in AND or t in ARTICLES else smooth(t) for t in tokens), dotted, "," in text, led, quoted


class Lexicon:
    """What is known of words: the ordinary ones of a table with their spread and number, and by-names seen in quotes.  Both are bounded by ``SHARE``."""

    def __init__(self, ordinary: dict[str, tuple[int, int]] | None = None, bynames: Iterable[str] = ()) -> None:
        self.ordinary, self.bynames = dict(ordinary or {}), frozenset(bynames)
        self.known = self.ordinary.keys() | _CALLED.keys()
        self.near: dict[str, set[str]] = {}
        self.starts: dict[str, list[str]] = {}
        for word in sorted(self.known):
            self.starts.setdefault(word[0], []).append(word)
            if len(word) >= 3:
                for key in _gone(word):
                    self.near.setdefault(key, set()).add(word)
        self._ranks: dict[tuple[str, bool], tuple[float, int]] = {}
        self._words: dict[tuple[str, str], bool] = {}

    def __reduce__(self):
        return Lexicon, (self.ordinary, self.bynames)

    def rank(self, word: str, dotted: bool) -> tuple[float, int]:
        """How little a word is an ordinary one, from 0 for an initial to 4 for a word that nothing known resembles, then by how few words it stands beside."""
        key = (word, dotted)
        if key not in self._ranks:
            if len(self._ranks) >= 1 << 17:
                self._ranks.clear()
            self._ranks[key] = self._rank(word, dotted)
        return self._ranks[key]

    def _rank(self, word: str, dotted: bool) -> tuple[float, int]:
        if len(word) == 1 or dotted and len(word) <= 5:
            return 0.0, 0
        if word in self.known:
            return 1.0 if word in _CALLED else 1.5, -self.ordinary.get(word, (0, 0))[0]
        if (len(word) <= 4 or not re.search("[aeiou]", word)) and any(_shortens(word, w) for w in self.starts.get(word[0], ())):
            return 1.1, 0
        if any(word[:i] in self.ordinary and word[i:] in self.ordinary for i in range(3, len(word) - 2)):
            return 1.6, 0
        near = self.near_words(word)
        return min((1.0 if w in _CALLED else 1.5, -self.ordinary.get(w, (0, 0))[0]) for w in near) if near else (4.0, 0)

    def near_words(self, word: str) -> list[str]:
        """Known words that a word may be a slip of."""
        if len(word) < 4 or word in self.known:
            return []
        most = 1 if len(word) < 7 else 2
        return sorted({w for key in _gone(word) for w in self.near.get(key, ()) if distance(word, w) <= most})

    def letters(self, others: Iterable[str]) -> list[str]:
        """First letters that words agreeing with these may have."""
        out = set()
        for token in others:
            bare = token.rstrip(".")
            for word in (bare, *(self.near_words(bare) if token == bare else ())):
                out.add(word[0])
                for full in _CALLED.get(word, ()):
                    out |= {full[0], *(short[0] for short in NICKNAMES[full].replace("y", "i").split())}
        return sorted(out or {""})

    def apart(self, artist: str | None) -> tuple[str, tuple[str, ...], bool, bool] | None:
        """``core, others, by, certain``; None for null and for text without letters.

        ``others`` are the words beside the core that can contradict it, ``by`` tells that a by-name stands
        in their place, ``certain`` that none of them is shortened.
        """
        if not artist or not artist.strip():
            return None
        tokens, dotted, comma, led, quoted = lex(artist)
        article = any(t in ARTICLES for t in tokens)
        words = [t for t in tokens if t not in ARTICLES]
        joined = len(words) > 2 and (any(t in AND for t in words[1:-1]) or any(t in AND and len(t) > 1 for t in words)) or any(t in "&+" for t in words)
        if joined or len(words) > 2:
            words = [t for i, t in enumerate(words) if not (t in AND and (t in "&+" or 0 < i < len(words) - 1 or len(t) > 1 or article and i == len(words) - 1))] or words
        words = [t for t in words if t not in "&+"]
        words = [smooth(t) for t in words if t not in TITLES or len(words) == 1] or words
        if article and len(words) == 2 and words[1] == "band":
            words = words[:1]
        if not words:
            return None
        ranks = [self.rank(t, t in dotted) for t in words]
        if len(words) > 1 and article and not joined and not comma and min(ranks)[0] > 2:
            words, ranks = ["".join(words)], [(4.0, 0)]
        order = [(r, t not in led if joined else True, -i if comma or joined else i) for i, (t, r) in enumerate(zip(words, ranks, strict=True))]
        at = max(range(len(words)), key=order.__getitem__)
        core, others = words[at], [t + "." if t in dotted else t for i, t in enumerate(words) if i != at]
        long = [t for t in others if len(t.rstrip(".")) > 1]
        if long:
            others = long  # middle initials say less than names
        called = [t for t in others if t in self.bynames and t not in _CALLED]
        by = bool(called) and len(called) == len(others)
        others = [t for t in others if t not in called]
        if not others:
            core = core[:-1] if core.endswith("s") and len(core) > 4 else core
        return core, tuple(others), by, not by and all(len(t) > 2 and not t.endswith(".") for t in others)

    def same_word(self, a: str, b: str) -> bool:
        """Whether two words beside a core can stand for each other: equal, called so, shortened or a slip; two ordinary words are no slips of each other."""
        if a == b:
            return True
        key = (a, b) if a < b else (b, a)
        if key not in self._words:
            self._words[key] = self._same_word(*key)
        return self._words[key]

    def _same_word(self, a: str, b: str) -> bool:
        if a.endswith(".") or b.endswith("."):
            x, y = a.rstrip("."), b.rstrip(".")
            short, long = (x, y) if len(x) <= len(y) else (y, x)
            return any(full.startswith(short) or _shortens(short, full) for full in (long, *map(smooth, _CALLED.get(long, ()))))
        if _CALLED.get(a, frozenset()) & _CALLED.get(b, frozenset()):
            return True
        short, long = sorted((a, b), key=len)
        if len(short) == 1:
            return any(w[0] == short for w in (long, *map(smooth, _CALLED.get(long, ()))))
        if a in _CALLED and b in _CALLED:
            return False
        if long.startswith(short) and (len(short) >= 3 or long not in _CALLED) or not re.search("[aeiou]", short[1:]) and _shortens(short, long):
            return True
        few, many = sorted((self.ordinary.get(a, (0, 0))[1], self.ordinary.get(b, (0, 0))[1]))
        if a in self.known and b in self.known and few * RARER > many:
            return False
        if len(short) <= 4 and _shortens(short, long):
            return True
        stem = re.sub(r"(?:ie|i|e|s)$", "", short)
        if len(stem) >= 3 and long.startswith(stem) and len(long) - len(stem) >= 2:
            return True
        if len(short) >= 4 and distance(a, b) <= (1 if len(short) < 7 else 2):
            return True
        # A slip in a name that goes by another.
        near = lambda w: {f for n in self.near_words(w) for f in _CALLED.get(n, ())} | _CALLED.get(w, frozenset())
        return bool(near(a) & near(b))

    def same_others(self, a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        """Whether the words beside two equal cores agree: each of the fewer finds a different one of the others; none agree with none only."""
        if a == b:
            return True
        few, many = sorted((tuple(a), tuple(b)), key=len)
        if not few:
            return False
        if len(few) == 1 and len(many) > 1 and (few[0].rstrip(".") == "".join(w[0] for w in many) or len(few[0]) > 7 and distance(few[0], smooth("".join(many))) <= 2):
            return True
        left = list(many)
        for word in sorted(few, key=len, reverse=True):
            hit = next((w for w in left if w == word), None) or next((w for w in left if self.same_word(word, w)), None)
            if hit is None:
                return False
            left.remove(hit)
        return True


def learn(artists: DataFrame, column: str = "artist") -> Lexicon:
    """The lexicon of all spellings of a column: ordinary words and by-names by their counts over the whole table.

    What comes to the driver is bounded: words of at least ``SHARE`` of all words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for artist in batch["artist"]:
                if not artist:
                    continue
                tokens, _, _, _, quoted = lex(artist)
                words = [t for t in tokens if len(t) > 1 and t not in AND and t not in ARTICLES]
                for i, word in enumerate(words):
                    for near in {w[:2] for j, w in enumerate(words[max(0, i - 3) : i + 4], max(0, i - 3)) if j != i and w != word} or {""}:
                        rows.append((word, near, 1, 0))
                rows += [(word, "", 0, 1) for word in quoted]
            yield pd.DataFrame(rows, columns=["word", "near", "n", "quoted"])

    spellings = artists.select(F.col(column).alias("artist")).where("artist is not null").distinct()
    seen = spellings.mapInPandas(run, "word string, near string, n bigint, quoted bigint").groupBy("word", "near").agg(F.sum("n").alias("n"), F.sum("quoted").alias("quoted"))
    words = cut(seen.groupBy("word").agg(F.sum(F.expr("if(near <> '' and n > 0, 1, 0)")).alias("spread"), F.sum("n").alias("n"), F.sum("quoted").alias("quoted")))
    total = words.agg(F.sum("n").alias("n"), F.sum("quoted").alias("q")).first()
    least, least_quoted = SHARE * (total.n or 0), max(1.0, SHARE * (total.q or 0))
    kept = words.where(((F.col("spread") >= SPREAD) & (F.col("n") >= least)) | (F.col("quoted") >= least_quoted)).toPandas()
    usual = kept[(kept.spread >= SPREAD) & (kept.n >= least)]
    return Lexicon(dict(zip(usual.word, zip(usual.spread.astype(int), usual.n.astype(int)), strict=True)), kept.loc[kept.quoted >= least_quoted, "word"])


_PARTS = "name_id bigint, uses bigint, core string, others array<string>, by boolean, certain boolean, refine array<string>"


def parse(artists: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Spellings taken apart, a row each; null and blank artists give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name_id, artist, uses in zip(batch["name_id"], batch["artist"], batch["uses"], strict=True):
                parts = lexicon.apart(artist)
                if parts:
                    rows.append((name_id, 0 if pd.isna(uses) else int(uses), *parts, lexicon.letters(parts[1])))
            yield pd.DataFrame(rows, columns=["name_id", "uses", "core", "others", "by", "certain", "refine"])

    return artists.select("name_id", "artist", "uses").mapInPandas(run, _PARTS)


_NODE = ("core", "others", "by")


def nodes_of(parts: DataFrame) -> DataFrame:
    """Spellings that come apart equally are one node: its id, uses and whether it is certain."""
    return parts.groupBy(*_NODE).agg(F.min("name_id").alias("node"), F.sum("uses").alias("uses"), F.min("certain").alias("certain"), F.first("refine").alias("refine"))


def _keys(nodes: DataFrame) -> DataFrame:
    """``node, core, others, key, short`` for every blocking key.

    Keys are suffixes of the core, and of the core read backwards, refined by a first letter of the other
    words.  The two of about half the core (of short cores a letter less than ``MIN_SUFFIX``) carry the
    core's length or the next, since one edit changes it by one; shorter ones, down to ``MIN_SUFFIX``,
    carry the letter at the core's other end, and two letters of either end go together.
    """
    size = F.length("core")
    half = F.ceil(size / 2).cast("int")
    least = lambda k: F.least(F.greatest(k, F.lit(MIN_SUFFIX - 1)), size)
    halves = F.array_distinct(F.array(least(half - 1), least(half)))
    ends = lambda k: F.array(F.concat(F.lit("<"), F.right("core", k)), F.concat(F.lit(">"), F.left("core", k)))
    long = F.flatten(F.transform(halves, lambda k: F.flatten(F.transform(ends(k), lambda e: F.array(F.concat_ws("|", e, size.cast("string")), F.concat_ws("|", e, (size + 1).cast("string")))))))
    shorter = F.when(half - 2 >= MIN_SUFFIX, F.sequence(F.lit(MIN_SUFFIX), half - 2)).otherwise(F.array().cast("array<int>"))
    shorter = F.array_distinct(F.concat(F.when(size > MIN_SUFFIX, F.array(F.lit(MIN_SUFFIX))).otherwise(F.array().cast("array<int>")), shorter))
    rims = F.flatten(F.transform(shorter, lambda k: F.array(F.concat(F.lit("<<"), F.right("core", k), F.left("core", F.lit(1))), F.concat(F.lit(">>"), F.left("core", k), F.right("core", F.lit(1))))))
    rims = F.concat(rims, F.when(size > 4, F.array(F.concat(F.lit("<>"), F.right("core", F.lit(2)), F.left("core", F.lit(2))))).otherwise(F.array().cast("array<string>")))
    each = nodes.select("node", "core", "others", F.explode("refine").alias("letter"), long.alias("long"), rims.alias("rims"))
    one = lambda name, short: each.select("node", "core", "others", "letter", F.explode(name).alias("suffix"), F.lit(short).alias("short"))
    return one("long", False).unionByName(one("rims", True)).withColumn("key", F.concat_ws("|", "letter", "suffix")).drop("letter", "suffix")


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that share a key, each once, whose cores are near enough."""
    keyed = _keys(nodes)
    usual = keyed.groupBy("key").agg(F.count("*").alias("n"), F.first("short").alias("rim"))
    usual = usual.where(f"n > 1 and (not rim or n <= {COMMON_KEY})").select("key")
    kept = keyed.join(usual, "key")
    left = kept.select("key", F.col("node").alias("a"), F.col("core").alias("core_a"), F.col("others").alias("others_a"))
    right = kept.select("key", F.col("node").alias("b"), F.col("core").alias("core_b"), F.col("others").alias("others_b"))
    # A swap counts twice here, so that two edits are four at most.
    pairs = left.join(right, "key").where("a < b and levenshtein(core_a, core_b, 4) >= 0")
    return pairs.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("core_a", "core_b", "others_a", "others_b")])


def edges(nodes: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Pairs of nodes whose cores are alike and whose other words agree: ``a, b, ratio``."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [ratio(a, b) if alike(a, b) and lexicon.same_others(tuple(x), tuple(y)) else 0.0 for a, b, x, y in zip(*batch, strict=True)], dtype="float64"
            )

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    score = F.pandas_udf(run, "double")
    named = candidate_pairs(nodes.where("not by"))
    return named.withColumn("ratio", score("core_a", "core_b", "others_a", "others_b")).where("ratio > 0").select("a", "b", "ratio")


def _linked(artists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spellings taken apart, nodes with the node that stands for their class, and edges between nodes."""
    lexicon = learn(artists)
    parts = cut(parse(artists, lexicon))
    nodes = cut(nodes_of(parts))
    links = cut(edges(nodes, lexicon))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio"))
    quality = F.struct("certain", F.col("uses").alias("uses"), (-F.col("node")).alias("least"))
    better = both.join(nodes.select(F.col("node").alias("b"), quality.alias("quality")), "b").join(nodes.select(F.col("node").alias("a"), quality.alias("own")), "a").where("quality > own")
    choice = better.groupBy("a").agg(F.max(F.struct((F.col("ratio") >= 1.0).alias("same"), F.round("ratio", 1).alias("near"), "quality", "b")).alias("best")).select("a", "best.b")
    # A by-name says nothing of the given name: it stands for the surest, most used bearer of the core.
    bearers = nodes.where("not by and size(others) > 0").groupBy("core").agg(F.max(F.struct("certain", "uses", (-F.col("node")).alias("least"))).alias("best"))
    by = nodes.where("by").join(bearers, "core").select(F.col("node").alias("a"), (-F.col("best.least")).alias("b"))
    pointers = cut(nodes.select(F.col("node").alias("a")).join(choice.unionByName(by), "a", "left").select("a", F.coalesce("b", "a").alias("to")))
    while True:  # pointers go to better nodes only, so they halve their way to the ends
        onward = pointers.select(F.col("a").alias("to"), F.col("to").alias("next"))
        jumped = cut(pointers.join(onward, "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        moved = jumped.where("moved").limit(1).count()
        pointers = jumped.select("a", "to")
        if not moved:
            break
    return parts, nodes.join(pointers, F.col("node") == F.col("a")).drop("a"), links.unionByName(by.select("a", "b", F.lit(1.0).alias("ratio")))


def _members(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    return parts.join(nodes.select(*_NODE, F.col("to").alias("class_id")), list(_NODE)).select("name_id", "class_id")


def classes(artists: DataFrame) -> DataFrame:
    """``name_id, class_id, links`` of every spelling with a name in it.

    ``links`` is the number of different spellings (nodes) it was directly found alike with.  Every node
    points to the surest, most used node that it is alike to, itself included, and pointers are followed
    to their ends; since pointers only go to better nodes, two names that share an uncertain spelling
    don't fall together through it.  Null and blank artists have no class; equal spellings share one; ties
    go to the smaller id; other columns are left out.
    """
    parts, nodes, links = _linked(artists)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    counted = nodes.join(ends, "node", "left").select(*_NODE, F.col("to").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return parts.join(counted, list(_NODE)).select("name_id", "class_id", "links")


def found(artists: DataFrame) -> DataFrame:
    """Every pair of rows that name the same person or group, smaller id first."""
    parts, nodes, _ = _linked(artists)
    members = cut(_members(parts, nodes))
    left = members.select("class_id", F.col("name_id").alias("name_id_a"))
    right = members.select("class_id", F.col("name_id").alias("name_id_b"))
    return left.join(right, "class_id").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
