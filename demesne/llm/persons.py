"""Reading of written personal names: surname core and possible forenames.

Words of a name that may be forenames meet the known given names and short
forms in the q-gram join of ``grams``; weighted edit distance verifies.  Which
word of a name is the forename is decided by the readings that came of it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demesne.llm.grams import prefix_join
from demesne.llm.text import deletes, letters, osa, plain, unlettered
from demesne.runtime import cut, lookup_join, spread

#: Given names of the period with their short forms and spellings.
FORENAMES = {
    "agnes": "aggie nancy",
    "alexander": "alex alexr alick sandy",
    "alice": "ally alicia alley elsie",
    "andrew": "andy andw andrw drew",
    "anne": "ann anna annie nan nancy hannah",
    "anthony": "tony anty anthy antony",
    "arthur": "art arty arthr",
    "bartholomew": "bart bartle batt bat barth barthw bartly bartw batty",
    "bernard": "barney bernd brian bryan",
    "bridget": "bidy biddy bride bridt bridgt bedelia delia bridie breda brigid",
    "catherine": "kate kitty katherine cath cathne cathn katy catharine kathleen cate kit cathrine",
    "charles": "charley chas charlie",
    "christopher": "christy kit xopher chris christr",
    "cornelius": "con corny corns corn connie neil corneilius",
    "daniel": "dan danl danny donal",
    "david": "davy dave davey",
    "denis": "dennis dinny denny dionysius",
    "dorothy": "dolly dora dorthy doll dot",
    "edmund": "edmd mun edmond eamon",
    "edward": "ned neddy edwd ed teddy ted eddy edw",
    "eleanor": "elinor eleanora elnr",
    "elizabeth": "eliza bessy bess betty lizzy elizth eliz liz beth lizzie betsy elisabeth elsie bessie libby",
    "ellen": "nelly nell ellin elly eileen helen nellie helena",
    "esther": "hester hetty essy",
    "frances": "fanny fran francs",
    "francis": "frank fras frans fr francs frankie",
    "garret": "gerald garrett gerrard",
    "george": "geo georgy geordie georg",
    "hannah": "hanna hana",
    "henry": "harry hy hen henery hal",
    "honora": "nora nory honor honoria onny norah nano hanora noney",
    "hugh": "hughie hugo hewy",
    "james": "jas jem jimmy jim jamsie jimmie jamie",
    "jane": "jenny jean jinny janey janie",
    "jeremiah": "jerry jerh jeremh jer darby jeremy jery",
    "johanna": "joan joanna johannah",
    "john": "jno jack johny johnny jon jn jonny sean shane",
    "joseph": "joe jos joey josh jo",
    "judith": "judy jude judth",
    "julia": "july jule sheila",
    "laurence": "larry lawrence laurce lar laur lawce lauce",
    "letitia": "letty lettice letita tish lettie",
    "luke": "lucas",
    "margaret": "peggy peg margt maggy meg madge marg margery mgt maggie margret rita",
    "mark": "marcus",
    "martin": "mart marty matty",
    "mary": "maria molly mamy moll polly may maire marie poll minnie",
    "matthew": "matt mattw mat matty mathew matthw",
    "michael": "mick mich michl mike micky mickey mikey",
    "maurice": "moss mossy morris muirish",
    "nicholas": "nick nichs nichls nicky nich nics nicols",
    "owen": "owny eugene eoin owney",
    "patrick": "pat paddy patk patt patsy patr paudge packy",
    "peter": "petr pete peadar",
    "philip": "phil philp phill phillip pilib",
    "rebecca": "becky rebca beck rebeca becca",
    "richard": "dick richd rich ricd dicky dickie",
    "robert": "bob robt rob bobby robin robbie",
    "rose": "rosy rosie rosanna",
    "samuel": "sam saml sammy",
    "sarah": "sally sara sal sarh sallie",
    "simon": "sim simeon",
    "stephen": "stevie steven stephn steph steve",
    "susan": "susy sukey suky susanna sue susannah",
    "teresa": "tess tessy treasa",
    "terence": "terry",
    "thomas": "tom thos tommy tho thom tomas",
    "timothy": "tim timy thady tady timthy thade tad teige",
    "una": "oona unah uny oonagh",
    "valentine": "val valente vally valent",
    "walter": "wat watty waltr",
    "william": "wm bill willm will billy willie willy liam",
    "winifred": "winny wini winifd win winnie freda",
}
#: Words in a name that name no one.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "rev", "revd", "fr", "sr", "senr", "sen", "jr", "junr", "jun", "widow", "wid", "widw", "capt", "sir", "esq", "master", "the", "late", "and", "wife", "child", "infant", "orphan", "pauper", "alias"}
#: least Jaccard similarity of a written word and a known one
GIVEN_JACCARD = 0.15
_BOOK: dict[str, dict[str, float]] = defaultdict(dict)
for _name, _short in FORENAMES.items():
    _BOOK[_name][_name] = 0.0
    for _s in _short.split():
        _BOOK[_s].setdefault(_name, 0.2)
_NEAR: dict[str, set[str]] = defaultdict(set)
for _w in _BOOK:
    if len(_w) >= 3:
        for _d in deletes(_w, 2 if len(_w) >= 7 else 1):
            _NEAR[_d].add(_w)


def _contraction(token: str, name: str) -> bool:
    """A shortened writing: the letters of ``name`` in order, the first one first, some left out."""
    at = iter(name)
    return token[0] == name[0] and len(token) < len(name) and all(c in at for c in token)


@lru_cache(maxsize=65536)
def forename_readings(token: str, near: tuple[str, ...] | None = None) -> tuple[tuple[str, float], ...]:
    """Possible given names of a written token with their costs, the likeliest only; () if it looks like none.

    ``near``: the words of the book that may be close (those of the q-gram
    join); by default all that share a deletion.
    """
    if not token or len(token) == 1:
        return ()
    costs: dict[str, float] = dict(_BOOK.get(token, {}))
    if not costs:
        if len(token) >= 3:
            for w in {w for d in deletes(token, 2 if len(token) >= 6 else 1) for w in _NEAR.get(d, ())} if near is None else near:
                most = 1.0 if len(w) <= 4 else 1.3 if len(w) <= 6 else 2.0
                d = osa(token, w, most)
                if d <= most:
                    for name, c in _BOOK[w].items():
                        costs[name] = min(costs.get(name, 9.0), c + d)
        for name in FORENAMES:
            if _contraction(token, name) and len(token) >= 2:
                costs[name] = min(costs.get(name, 9.0), 0.5 + 0.1 * (len(name) - len(token)))
    if not costs:
        return ()
    least = min(costs.values())
    margin = 0.3 if least > 0 else 0.0
    return tuple(sorted((n, round(c, 3)) for n, c in costs.items() if c <= least + margin))


_GLUED = re.compile(r"^(?:mac(?=[a-z]{4})|mc|m'|o')")


@lru_cache(maxsize=65536)
def name_words(text: str | None) -> tuple[tuple[str, ...], bool]:
    """(words of a name, whether a comma parts it): titles, marks of doubt, case and accents undone; ``~`` joins a particle to its name."""
    if not text:
        return (), False
    t = plain(text)
    t = re.sub(r"\[[^\]]*\]?|\([^)]*\)?|\?", " ", t)
    comma = "," in t
    t = re.sub(r"[.,;:/\"*]+", " ", t)
    t = re.sub(r"\s*'\s*", "'", t).strip(" '-")
    t = re.sub(r"\b(mac|mc|o|ua)[\s]+(?=[a-z'0-9]{3,})", r"\1~", t)
    words = [w.strip("-'") for w in t.split()]
    return tuple(w for w in words if w and w.replace("~", "") not in TITLES), comma


def may_be_given(word: str) -> str:
    """The letters under which a word of a name is looked up as a forename; '' for one with a particle."""
    if "~" in word or word.startswith(("m'", "o'")):
        return ""
    return letters(unlettered(word))


def read_name(text: str | None, readings: Callable[[str], Sequence[tuple[str, float]]] = forename_readings) -> tuple[str, tuple[str, ...], str]:
    """(surname core, possible forenames, initial).

    The surname core has no Mc, Mac, M' or O'.  ``initial`` is filled, and the
    forenames empty, where only an initial is written.  Order, titles, marks of
    doubt, case and accents don't matter.  Blank and null give ("", (), "").
    ``readings`` gives the forenames a word may mean.
    """
    words, comma = name_words(text)
    found: list[tuple[str, str]] = []
    for w in words:
        if w.startswith("o~") and len(words) == 1:
            found.append(("o", ""))
        core = _GLUED.sub("", w.split("~")[-1]) if "~" in w else w if w.startswith("mc") and readings(may_be_given(w)) else _GLUED.sub("", w)
        marked = core != w
        core = letters(unlettered(core)) or letters(w)
        if core:
            found.append((core, "s" if marked else ""))
    if not found:
        return "", (), ""
    if len(found) == 1:
        return found[0][0], (), ""
    best = None
    for i, (w, kind) in enumerate(found):
        if kind == "s":
            continue
        meant = readings(w)
        cost = min((c for _, c in meant), default=None)
        if cost is not None and w.startswith("mc"):
            cost += 0.5
        if cost is None:
            if len(w) > 1:
                continue
            cost = 0.9
        # after a comma, and last, a forename is likelier
        cost -= 0.05 * (i == len(found) - 1) + 0.05 * comma * (i > 0)
        if best is None or cost < best[0]:
            best = (cost, i, meant)
    if best is None:
        i = len(found) - 1 if comma else 0
        if len(found[i][0]) > len(found[1 - i][0]) * 3 and len(found) == 2:
            i = 1 - i
        return "".join(w for k, (w, _) in enumerate(found) if k != i), (found[i][0],), ""
    _, i, meant = best
    rest = [w for k, (w, _) in enumerate(found) if k != i and len(w) > 1] or [w for k, (w, _) in enumerate(found) if k != i]
    surname = max(rest, key=len)
    token = found[i][0]
    return (surname, tuple(n for n, _ in meant), "") if len(token) > 1 else (surname, (), token)


NAME = T.StructType([T.StructField("surname", T.StringType()), T.StructField("forenames", T.ArrayType(T.StringType())), T.StructField("initial", T.StringType())])


_READINGS = T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("costs", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lookups(text: pd.Series) -> pd.Series:
    """Words of a written name that are looked up as forenames."""
    return text.map(lambda t: sorted({x for w in name_words(t)[0] if len(x := may_be_given(w)) > 1}))


@F.pandas_udf(_READINGS)
def _read(token: pd.Series, near: pd.Series) -> pd.DataFrame:
    got = [forename_readings(t, tuple(sorted(n)) if n is not None else ()) for t, n in zip(token, near)]
    return pd.DataFrame({"names": [[n for n, _ in g] for g in got], "costs": [[c for _, c in g] for g in got]})


@F.pandas_udf(NAME)
def _person(text: pd.Series, readings: pd.Series) -> pd.DataFrame:
    rows = []
    for t, known in zip(text, readings):
        by = {r["token"]: tuple(zip(r["names"], r["costs"])) for r in (known if known is not None else ())}
        rows.append(read_name(t, lambda w: by.get(w, ())))  # noqa: B023
    return pd.DataFrame({"surname": [r[0] for r in rows], "forenames": [list(r[1]) for r in rows], "initial": [r[2] for r in rows]})


def given_names(tokens: DataFrame) -> DataFrame:
    """(token, names, costs) of each distinct ``token``: the given names it may mean, found by the q-gram join; tokens that look like none have no row."""
    tokens = tokens.select("token").where("token <> ''").distinct()
    # the book is a fixed list of some 500 words
    book = tokens.sparkSession.createDataFrame([(w,) for w in sorted(_BOOK)], "word string")
    met = prefix_join(tokens.select(F.col("token").alias("word")), book, GIVEN_JACCARD, exact=False).groupBy(F.col("word").alias("token")).agg(F.collect_set("anchor").alias("near"))
    got = spread(tokens.join(met, "token", "left"), "token").withColumn("r", _read("token", "near"))
    return got.select("token", F.col("r.names").alias("names"), F.col("r.costs").alias("costs")).where(F.size("names") > 0)


def with_names(df: DataFrame, name: str) -> DataFrame:
    """Adds ``n``, struct(surname, forenames, initial), read from column ``name``; each distinct writing is read once."""
    texts = cut(spread(df.select(F.col(name).alias("__text")).where(F.col("__text").isNotNull()).distinct(), "__text").withColumn("__tokens", _lookups("__text")))
    token = texts.select("__text", F.explode("__tokens").alias("token"))
    readings = cut(given_names(token.select("token")))
    found = lookup_join(token, readings, ["token"]).groupBy("__text").agg(F.collect_list(F.struct("token", "names", "costs")).alias("__readings"))
    read = texts.join(found, "__text", "left").select("__text", _person("__text", "__readings").alias("n"))
    out = lookup_join(df.withColumn("__text", F.col(name)), read, ["__text"], "left").drop("__text")
    return out.withColumn("n", F.coalesce("n", F.struct(F.lit("").alias("surname"), F.array().cast("array<string>").alias("forenames"), F.lit("").alias("initial"))))
