"""Column functions over dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S

# Month names by language, in the order of months (nominative, genitive where it differs, and short ones of three letters or more). Kyrgyz has the Russian names, Uzbek the short ones of Azerbaijani but for avg.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "ru": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
    "ru genitive": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "tr": "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık",
    "az": "yanvar fevral mart aprel may iyun iyul avqust sentyabr oktyabr noyabr dekabr",
    "uz": "yanvar fevral mart aprel may iyun iyul avgust sentabr oktabr noyabr dekabr",
    "ka": "იანვარი თებერვალი მარტი აპრილი მაისი ივნისი ივლისი აგვისტო სექტემბერი ოქტომბერი ნოემბერი დეკემბერი",
    "hy": "հունվար փետրվար մարտ ապրիլ մայիս հունիս հուլիս օգոստոս սեպտեմբեր հոկտեմբեր նոյեմբեր դեկտեմբեր",
    "hy genitive": "հունվարի փետրվարի մարտի ապրիլի մայիսի հունիսի հուլիսի օգոստոսի սեպտեմբերի հոկտեմբերի նոյեմբերի դեկտեմբերի",
    "en short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "ru short": "янв фев мар апр май июн июл авг сен окт ноя дек",
    "tr short": "oca şub mar nis may haz tem ağu eyl eki kas ara",
    "uz short": "yan fev mar apr may iyn iyl avg sen okt noy dek",
    "az short": "yan fev mar apr may iyn iyl avq sen okt noy dek",
    "kk short": "қаң ақп нау сәу мам мау шіл там қыр қаз қар жел",
    "ka short": "იან თებ მარ აპრ მაი ივნ ივლ აგვ სექ ოქტ ნოე დეკ",
    "hy short": "հնվ փտվ մրտ ապր մյս հնս հլս օգս սեպ հոկ նոյ դեկ",
    "kk": "қаңтар ақпан наурыз сәуір мамыр маусым шілде тамыз қыркүйек қазан қараша желтоқсан",
}


def _fold(text: str) -> str:
    return text.lower().replace("ı", "i").replace("̇", "")


NUMBERS = {_fold(name): i for names in MONTHS.values() for i, name in enumerate(names.split(), 1)}


def fold(text: Column) -> Column:
    """Lower case with the dotless and the dotted i as one."""
    return F.replace(F.replace(F.lower(text), F.lit("ı"), F.lit("i")), F.lit("̇"), F.lit(""))


def parse_iso(raw: Column) -> Column:
    """The first ISO date in a text, if it exists in the calendar."""
    return F.try_to_date(F.regexp_extract(F.coalesce(raw, F.lit("")), r"\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd")


def dump_date(raw: Column) -> Column:
    """The date at the start of a dump's time stamp."""
    return F.when(F.coalesce(raw, F.lit("")).rlike(r"^\d{8}"), F.try_to_date(F.substring(raw, 1, 8), "yyyyMMdd"))


def mentioned(text: Column, day: Column) -> Column:
    """Whether a text names the day, in words (the year may be left out) or figures."""
    low = fold(F.coalesce(text, F.lit("")))
    months = "|".join(sorted(NUMBERS, key=len, reverse=True))
    named = r"(?U)\b(\d{1,2})\s*[-–]?\s*(?:го\b|nji\b|inci\b)?\s*(" + months + r")\w*(?:\s*,?\s*(\d{4}))?"
    part = lambda pattern, k: F.regexp_extract_all(low, F.lit(pattern), F.lit(k))
    number = F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair))
    d, m, y = F.dayofmonth(day), F.month(day), F.year(day)
    rows = F.arrays_zip(part(named, 1).alias("d"), part(named, 2).alias("m"), part(named, 3).alias("y"))
    in_words = F.exists(rows, lambda r: (r["d"].cast("int") == d) & (number[r["m"]] == m) & ((r["y"] == "") | (F.try_to_number(r["y"], F.lit("9999")).cast("int") == y)))
    figures = lambda pattern, *order: F.exists(F.arrays_zip(*(part(pattern, k + 1).alias(str(k)) for k in range(3))), lambda r: (r["0"].cast("int") == order[0]) & (r["1"].cast("int") == order[1]) & (r["2"].cast("int") == order[2]))
    return F.coalesce(in_words | figures(r"\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b", d, m, y) | figures(r"\b(\d{4})-(\d{2})-(\d{2})\b", y, m, d), F.lit(False))


def clamp(iso: Column, today: Column, days: int = S.EVENT_WINDOW_DAYS) -> Column:
    """The date as text if it lies in the last days up to today, else ''."""
    d = parse_iso(iso)
    return F.when(d.between(F.date_sub(today, days), today), d.cast("string")).otherwise("")


def choose(raw: Column, published: Column, source: Column, today: Column, days: int = S.EVENT_WINDOW_DAYS) -> Column:
    """A struct of the date to print and the reason for not taking the event's date: '' where it is taken or missing."""
    d, pub = parse_iso(raw), parse_iso(published)
    fallback = clamp(published, today, days)
    pair = lambda date, reason: F.struct(date.alias("date"), F.lit(reason).alias("reason"))
    return (
        F.when(d.isNull() & F.coalesce(raw, F.lit("")).isin("", "null"), pair(fallback, ""))
        .when(d.isNull(), pair(fallback, "not a date"))
        .when(pub.isNotNull() & (d > pub), pair(fallback, "after publication"))
        .when(~d.between(F.date_sub(today, days), today), pair(fallback, "outside the window"))
        .when(~mentioned(source, d), pair(fallback, "not mentioned"))
        .otherwise(pair(d.cast("string"), ""))
    )


def display(iso: Column) -> Column:
    """dd.mm.yyyy, or the text as it is."""
    return F.coalesce(F.date_format(parse_iso(iso), "dd.MM.yyyy"), iso)


def local_time(epoch: Column, zone: str = "Europe/Moscow") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), "dd.MM.yyyy HH:mm")
