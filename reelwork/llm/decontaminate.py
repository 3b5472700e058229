"""Benchmark leaks by canonical templates.

Numbers, names and units become typed placeholders (a run of numbers or of names is one
placeholder), everything else is lower case without punctuation. Windows of the template that
a document shares with a benchmark item are joined by hash; along one alignment of the two,
or a chain of near ones where words were put in or left out, every value that the item has in
a placeholder must stand for one value in the document. That finds passages that were copied,
and questions asked again with other numbers or names.

Names are read in two ways, and an item is held if it is by either of them. By case, a name is
a capital word of any script, wherever it stands, that is no function word and not part of a sentence
all in capitals. By words, it is any word that the benchmark does not use as a plain word, whatever
its case. Neither can tell a name in an item without any capitals, or in a script without case.
Number, unit and function words are lists for some European languages; digits are those of any script.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelwork.llm.casing import APART, DIGIT, SMALL, UPPER, cased
from reelwork.llm.kernel import IS_SPACE, U64, inside, lists, mix, pieces, prefix_hash, rolled, span_hash
from reelwork.llm.shared import bit_filter, documents, in_filter, keep
from reelwork.session import arrow_map

WINDOW = 6
#: A window counts if at least so many of its tokens are words and not placeholders.
LITERALS = 4
#: A document holds an item if one alignment, or a chain of near ones, matches this percentage of its windows.
PERCENT = 60
#: Alignments are chained if their shifts differ by at most so many tokens from one to the next.
SLACK = 3
#: An item too short for a window counts wherever its tokens stand, from so many tokens; a shorter one only as a whole document.
LEAST_TOKENS = 3
#: The way of an item too short for a window is this and its number of tokens.
SHORT = 10
#: A sentence without small letters is upper case from this many words, and tells no names.
LOUD = 3

# word lists by language; fixed values
NUMBERS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen milliarde milliarden",
    "fr": "zéro deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante cent cents mille million millions milliard milliards",
    "es": "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento doscientos trescientos quinientos mil millón millones",
    "it": "due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove venti trenta quaranta cinquanta sessanta settanta ottanta novanta cento mille mila milione milioni",
    "pt": "dois duas três quatro cinco oito nove dez onze doze treze quatorze quinze dezesseis dezessete dezoito dezenove vinte trinta quarenta cinquenta sessenta oitenta cem cento duzentos mil milhão milhões",
    "ru": "ноль один два две три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто сто двести триста тысяча тысячи тысяч миллион миллиона миллионов",
    "pl": "zero jeden dwa dwie trzy cztery pięć sześć siedem osiem dziewięć dziesięć jedenaście dwanaście trzynaście piętnaście dwadzieścia trzydzieści czterdzieści pięćdziesiąt sześćdziesiąt sto dwieście tysiąc tysiące tysięcy milion",
}
_TENS_DE = ("zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig", "neunzig")
NUMBER_WORDS = sorted({w for text in NUMBERS.values() for w in text.split()} | {f"{one}und{ten}" for one in ("ein", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun") for ten in _TENS_DE} | {f"veinti{x}" for x in ("uno", "dós", "trés", "cuatro", "cinco", "séis", "siete", "ocho", "nueve")})
UNIT_WORDS = {
    "en": "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers centimeter centimeters",
    "de": "meile meilen metern kilometern zentimeter zentimetern millimeter zoll fuß gramm kilo kilogramm pfund tonne tonnen litern sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad",
    "fr": "mètre mètres kilomètre kilomètres centimètre centimètres millimètre millimètres mille milles pied pieds pouce pouces gramme grammes kilogramme kilogrammes kilos livre livres tonne tonnes seconde secondes heure heures jour jours semaine semaines mois année années degré degrés",
    "es": "metro metros kilómetro kilómetros centímetro centímetros milímetro milímetros milla millas pie pies pulgada pulgadas gramo gramos kilogramo kilogramos libra libras tonelada toneladas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares centavo centavos grado grados",
    "it": "metri chilometro chilometri centimetro centimetri miglio miglia piede piedi grammo grammi chilo chili libbra libbre tonnellata tonnellate litri secondo secondi minuti ora ore giorno giorni settimana settimane mese mesi anno anni grado gradi",
    "pt": "quilômetro quilômetros centímetros milha milhas grama gramas quilo quilos quilograma quilogramas toneladas segundos minutos dia dias semana semanas mês meses ano anos real reais grau graus",
    "ru": "метр метра метров километр километра километров сантиметр сантиметра сантиметров миля мили миль грамм грамма граммов килограмм килограмма килограммов тонна тонны тонн литр литра литров секунда секунды секунд минута минуты минут час часа часов день дня дней неделя недели недель месяц месяца месяцев год года лет рубль рубля рублей доллар доллара долларов процент процента процентов градус градуса градусов",
    "pl": "metry metrów kilometr kilometry kilometrów mila mile mil gram gramy gramów kilogram kilogramy kilogramów litr litry litrów sekunda sekundy sekund minuta minuty minut godzina godziny godzin dzień dni tydzień tygodnie tygodni miesiąc miesiące miesięcy rok lata lat złoty złote złotych procent stopni",
}
UNITS = sorted({w for text in UNIT_WORDS.values() for w in text.split()} - set(NUMBER_WORDS))
#: Words that are no names, also where they open a sentence.
NO_NAMES = {
    "en": "a an the this that these those some any each every all both no none not i you he she it we they me him her us them my your his its our their one's who whom whose which what when where why how "
    "if then else than so as because since while until unless although though after before during and or but nor yet for of in on at by to from with without into onto over under between among about against through across along around "
    "is are was were be been being am do does did done has have had having can could will would shall should may might must there here now also only just more most less least many much few another other such same "
    "let find given suppose assume calculate compute determine solve show prove consider explain write choose select what's it's once twice next first last finally later today yesterday tomorrow",
    "de": "der die das den dem des ein eine einen einem einer eines dieser diese dieses jeder jede jedes alle kein keine ich du er sie es wir ihr mich mir ihm ihn uns ihnen mein dein sein unser wer was wann wo warum wie welche welcher welches wenn dann als weil während nach vor und oder aber denn von im in an am auf bei zu zum zur aus mit ohne über unter zwischen für um ist sind war waren wird werden wurde hat haben hatte kann können muss soll es gibt wieviel wie viele viel",
    "fr": "le la les un une des du de ce cet cette ces chaque tout tous toute aucun je tu il elle nous vous ils elles me lui leur mon ton son notre votre qui que quoi quand où pourquoi comment quel quelle quels si alors parce pendant après avant et ou mais donc car dans sur sous par pour avec sans entre chez vers est sont était sera a ont avait peut doit combien il y",
    "es": "el la los las un una unos unas este esta estos estas ese esa cada todo todos ningún yo tú él ella nosotros ellos ellas me le les mi tu su nuestro quien quién que qué cuando cuándo donde dónde por cómo cuál cuáles si entonces porque durante después antes y o pero de del en con sin sobre entre para hasta desde es son era fue será ha han había puede debe cuánto cuántos cuántas hay",
    "it": "il lo la i gli le un uno una questo questa questi ogni tutti io tu lui lei noi voi loro chi che cosa quando dove perché come quale se allora dopo prima e o ma di del della in con senza su tra per è sono era ha hanno può deve quanto quanti quante",
    "ru": "и в во на с со к ко от до из у о об за по при для без через между под над не ни что кто как где когда почему если то так а но или же это этот эта эти тот та те он она оно они мы вы я его её их наш ваш мой свой сколько какой какая какие был была было были есть будет может",
    "pl": "i w we na z ze do od o u za po przy dla bez przez między pod nad nie co kto jak gdzie kiedy dlaczego jeśli to ten ta te on ona ono oni my wy ja jego jej ich ile jaki jaka jakie jest są był była było były będzie może",
}
FUNCTION_WORDS = sorted({w for text in NO_NAMES.values() for w in text.split()})
#: Plain words of the benchmark that go to every task as they are, 8 bytes each; beyond that a bitmap goes, and the words that it takes for plain by mistake.
MOST_PLAIN = 1 << 23
PLAIN_BITS = 29

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True
PLACEHOLDERS = mix(np.arange(1, 4, dtype=U64) * U64(0xABCDEF0123456789))  # number, unit, name
_SALTS = mix(np.arange(11, 13, dtype=U64))  # names by case, names by words
_KINDS = ("id long", "way int", "hash long", "at int", "slots array<long>", "n_windows int")


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(span_hash(prefix_hash(data), np.concatenate([[0], ends[:-1]]), ends))


_NUMBER_HASHES, _UNIT_HASHES, _FUNCTION_HASHES = _hashes(NUMBER_WORDS), _hashes(UNITS), _hashes(FUNCTION_WORDS)


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


@dataclass
class Tokens:
    """Tokens of a piece: byte spans, the document of each, its value's hash, and what it looks like."""

    starts: np.ndarray
    stops: np.ndarray
    doc: np.ndarray
    prefix: np.ndarray
    value: np.ndarray
    number: np.ndarray
    unit: np.ndarray
    function: np.ndarray
    capital: np.ndarray
    loud: np.ndarray
    apart: np.ndarray  # something other than white space, or a new document, comes before


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    lower, look = cased(data)
    letter = np.append(_LETTER[data] & (look & APART == 0), False)
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    begins[offsets[:-1]] |= letter[offsets[:-1]]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] |= letter[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    n = len(starts)
    doc = np.searchsorted(offsets, starts, "right") - 1
    if not n:
        no = np.zeros(0, bool)
        return Tokens(starts, stops, doc, np.zeros(1, U64), np.zeros(0, U64), no, no, no, no, no, no)
    c = prefix_hash(lower)
    value = span_hash(c, starts, stops)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    digits, breaks, small, marks = count(look & DIGIT > 0), count(_STOP[data]), count(look & SMALL > 0), count(~letter[:-1] & ~IS_SPACE[data])
    new_doc = np.ones(n, bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    opens, apart = new_doc.copy(), new_doc.copy()
    opens[1:] |= breaks[starts[1:]] > breaks[stops[:-1]]
    apart[1:] |= marks[starts[1:]] > marks[stops[:-1]]
    sentence = np.cumsum(opens) - 1
    loud = ((np.bincount(sentence, small[stops] > small[starts]) == 0) & (np.bincount(sentence) >= LOUD))[sentence]
    number = (digits[stops] > digits[starts]) | _among(_NUMBER_HASHES, value)
    return Tokens(starts, stops, doc, c, value, number, _among(_UNIT_HASHES, value), _among(_FUNCTION_HASHES, value), look[starts] & UPPER > 0, loud, apart)


def templates(t: Tokens, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the pieces' templates: its document, its hash, its kind (0: a word) and its own value's hash."""
    n = len(t.starts)
    kind = np.select([t.number, t.unit, name & ~t.function], [1, 2, 3], 0).astype(np.int8)
    head = np.ones(n, bool)
    same = (kind[1:] == kind[:-1]) & (t.doc[1:] == t.doc[:-1])
    head[1:] = ~(same & ((kind[1:] == 1) | ((kind[1:] == 3) & ~t.apart[1:])))
    at = np.flatnonzero(head)
    to = np.append(at[1:], n)[: len(at)] - 1
    value = span_hash(t.prefix, t.starts[at], t.stops[to])
    kind = kind[at]
    return t.doc[at], np.where(kind == 0, value, PLACEHOLDERS[np.maximum(kind, 1) - 1]), kind, value


@dataclass
class Plain:
    """The benchmark's plain words: their sorted hashes, or a bitmap of them and the sorted hashes of other words that it holds too."""

    words: np.ndarray
    bits: np.ndarray | None = None

    def holds(self, values: np.ndarray) -> np.ndarray:
        each, at = np.unique(values, return_inverse=True)
        if not len(each) or not len(self.words) and self.bits is None:
            return np.zeros(len(values), bool)
        listed = _among(self.words, each) if len(self.words) else np.zeros(len(each), bool)
        return (listed if self.bits is None else in_filter(self.bits, each) & ~listed)[at]


def windows(t: Tokens, way: int, plain: Plain, n_docs: int, bits: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Windows: document, hash, position, slot values one after another, slots of each, windows of its document.

    way 0 tells names by case, way 1 by plain, the benchmark's words. Without bits,
    as for the benchmark, only the windows with enough words, if the document has any.
    """
    doc, token, kind, value = templates(t, t.capital & ~t.loud if way == 0 else ~plain.holds(t.value))
    at = inside(doc, WINDOW)
    words = np.concatenate([[0], np.cumsum(kind == 0)])
    literal = words[at + WINDOW] - words[at] >= LITERALS
    # a window of few words says too little as a template, so it counts by its values
    hashes = mix(np.where(literal, rolled(token, WINDOW)[at], mix(rolled(value, WINDOW)[at])) ^ _SALTS[way])
    if bits is None:
        templated = np.bincount(doc[at], literal, n_docs) > 0
        own = literal | ~templated[doc[at]]
        at, hashes = at[own], hashes[own]
    total = np.bincount(doc[at], minlength=n_docs)
    if bits is not None:
        hit = in_filter(bits, hashes)
        at, hashes = at[hit], hashes[hit]
    span = at[:, None] + np.arange(WINDOW)
    slot = kind[span] > 0
    begin = np.searchsorted(doc, doc[at])
    return doc[at], hashes, at - begin, value[span][slot], slot.sum(1), total[doc[at]]


def whole_runs(t: Tokens, length: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each run of so many tokens, by their values, that may be a short item."""
    at = inside(t.doc, length)
    if length < LEAST_TOKENS:
        at = at[np.bincount(t.doc, minlength=n_docs)[t.doc[at]] == length]
    return t.doc[at], mix(rolled(t.value, length)[at] + U64(SHORT + length))


def plain_words(rows: DataFrame) -> DataFrame:
    """(hash) of the words of rows (text) that stand there without a capital, or in a sentence all in capitals."""
    schema = StructType.fromDDL("hash long")

    def run(batches):
        for batch in batches:
            for _part, data, offsets in pieces(batch, "text"):
                t = tokens_of(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(t.value[~t.capital | t.loud]).view(np.int64))], names=schema.names)

    return arrow_map(rows.select("text"), run, schema)


def _sorted_hashes(table: DataFrame) -> np.ndarray:
    return np.sort(table.toPandas()["hash"].to_numpy(np.int64).view(U64)) if table is not None else np.zeros(0, U64)


def words_in(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(hash) of the words of rows (text) that a bitmap holds."""
    schema = StructType.fromDDL("hash long")
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            for _part, data, offsets in pieces(batch, "text"):
                each = np.unique(tokens_of(data, offsets).value)
                yield pa.RecordBatch.from_arrays([pa.array(each[in_filter(shared.value, each)].view(np.int64))], names=schema.names)

    return arrow_map(rows.select("text"), run, schema).distinct()


def plain_set(items: DataFrame, docs: DataFrame) -> Plain:
    """The plain words of items, exact for every word of items and docs.

    Up to MOST_PLAIN words go to the tasks as they are. More go as a bitmap of fixed size; the words of both tables
    that it holds are then joined with the plain words, and those that are none go along with it.
    """
    words = keep(plain_words(items).distinct())
    if words.count() <= MOST_PLAIN:
        return Plain(_sorted_hashes(words))
    bits = bit_filter(words, "hash", PLAIN_BITS)
    wrong = words_in(docs.select("text").unionByName(items.select("text")), bits).join(words, "hash", "left_anti")
    return Plain(_sorted_hashes(wrong), bits)


def template_windows(rows: DataFrame, plain: Plain, bits: np.ndarray | None = None, lengths: list[int] | None = None) -> DataFrame:
    """id, way, hash, at, slots, n_windows for rows (id, text): all windows, or those whose hash is in the filter.

    Items without a window in either way have one row of all their tokens; of documents, those
    of lengths are looked at.
    """
    schema = StructType.fromDDL(", ".join(_KINDS))
    shared = rows.sparkSession.sparkContext.broadcast((plain, bits))

    def found(tokens: Tokens, n_docs: int, plain: Plain, bits: np.ndarray | None):
        windowed = np.zeros(n_docs, bool)
        for way in range(len(_SALTS)):
            made = windows(tokens, way, plain, n_docs, bits)
            windowed[made[0]] = True
            yield way, made
        size = np.bincount(tokens.doc, minlength=n_docs)
        for length in np.unique(size[~windowed & (size > 0)]).tolist() if bits is None else lengths or []:
            doc, hashes = whole_runs(tokens, length, n_docs)
            own = np.flatnonzero(~windowed[doc] & (size[doc] == length)) if bits is None else np.flatnonzero(in_filter(bits, hashes))
            none = np.zeros(len(own), np.int64)
            yield SHORT + length, (doc[own], hashes[own], none, np.zeros(0, U64), none, none + 1)

    def run(batches):
        plain, bits = shared.value
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                tokens = tokens_of(data, offsets)
                for way, (doc, hashes, at, values, n, total) in found(tokens, len(offsets) - 1, plain, bits):
                    ids = part.column("id").take(pa.array(doc, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(doc), way, np.int32)), pa.array(hashes.view(np.int64)), pa.array(at, pa.int32()), lists(values.view(np.int64), n, pa.int64()), pa.array(total, pa.int32())], names=schema.names)

    return arrow_map(rows.select("id", "text"), run, schema)


def alignments(pairs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, item_id, item_windows, matched_windows, bound) of the single shifts, and of the chains of near shifts, that match enough windows.

    In a chain each window of the item counts once, at the shift that matches most, and only
    where it comes after the one before it in the document too.
    """
    one = ["doc_id", "item_id", "way", "item_windows"]
    enough = lambda n: 100 * n >= percent * F.col("item_windows")
    shifts = pairs.groupBy(*one, "shift").agg(F.count_distinct("item_at").alias("matched_windows"), F.collect_set(F.struct("item_at", "bound")).alias("hits"))
    order = W.partitionBy(*one).orderBy("shift")
    begins = F.coalesce((F.col("shift") - F.lag("shift").over(order) > SLACK).cast("int"), F.lit(0))
    shifts = shifts.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(order))
    chain = W.partitionBy(*one, "chain")
    shifts = shifts.withColumn("in_chain", F.sum("matched_windows").over(chain)).where(enough(F.col("in_chain")))
    flat = lambda hits: F.array_distinct(F.flatten(hits))
    single = shifts.where(enough(F.col("matched_windows"))).select(*one, "matched_windows", flat(F.col("hits.bound")).alias("bound"))
    hits = shifts.where(F.col("in_chain") > F.col("matched_windows")).select(*one, "chain", "shift", "matched_windows", F.explode("hits").alias("hit"))
    best = hits.groupBy(*one, "chain", F.col("hit.item_at").alias("item_at")).agg(F.max_by(F.struct("shift", "hit.bound"), F.struct("matched_windows", -F.abs("shift"), "shift")).alias("x"))
    at = F.col("item_at") + F.col("x.shift")
    best = best.withColumn("ordered", F.coalesce(at > F.lag(at).over(chain.orderBy("item_at")), F.lit(True))).where("ordered")
    chained = best.groupBy(*one, "chain").agg(F.count("*").alias("matched_windows"), flat(F.collect_list("x.bound")).alias("bound"))
    return single.unionByName(chained.where(enough(F.col("matched_windows"))).drop("chain"))


def benchmark_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, exact) for the items (item_id, text) that documents (doc_id, text) hold.

    exact: every placeholder has the item's own value. An item all of whose windows have fewer
    than LITERALS words is found where it was copied; so is one with fewer than WINDOW tokens,
    which of under LEAST_TOKENS only a whole document can be. Null texts and texts without a
    token match nothing.
    Rows with a null id are left out. Repeated rows give one row for each pair of ids.
    """
    plain = plain_set(items, docs)
    bench = keep(template_windows(items.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), "text"), plain).distinct())
    lengths = [r.way - SHORT for r in bench.where(F.col("way") >= SHORT).select("way").distinct().collect()]
    found = template_windows(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text"), plain, bit_filter(bench, "hash"), lengths)
    b = bench.select("hash", "way", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("n_windows").alias("item_windows"))
    pairs = found.join(b, ["hash", "way"]).select(F.col("id").alias("doc_id"), "item_id", "way", "item_windows", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), F.arrays_zip("item_slots", "slots").alias("bound"))
    values = F.array_distinct(F.transform("bound", lambda x: x["item_slots"]))
    exact = F.forall("bound", lambda x: x["item_slots"] == x["slots"])
    good = alignments(pairs, percent).where(F.size("bound") == F.size(values)).withColumn("exact", exact)
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("matched_windows") / F.col("item_windows")).alias("share"), "exact", "matched_windows", "item_windows")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.matched_windows").cast("long").alias("matched_windows"), F.col("x.item_windows").cast("long").alias("item_windows"), F.col("x.exact").alias("exact"))


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
