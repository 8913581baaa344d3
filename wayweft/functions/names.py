"""Street-name functions as Column expressions: canonical form, similarity, and the name builders of the sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayweft.functions.binding import let

#: Words and their canonical abbreviations (directions, titles, postal street types).
WORDS = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
    "JUNIOR": "JR", "SAINT": "ST",
    "ALLEY": "ALY", "ANNEX": "ANX", "ARCADE": "ARC", "AV": "AVE", "AVENUE": "AVE", "BAYOU": "BYU", "BEACH": "BCH", "BEND": "BND",
    "BLUFF": "BLF", "BLUFFS": "BLFS", "BOTTOM": "BTM", "BOULEVARD": "BLVD", "BRANCH": "BR", "BRIDGE": "BRG", "BROOK": "BRK",
    "BROOKS": "BRKS", "BURG": "BG", "BURGS": "BGS", "BYPASS": "BYP", "CAMP": "CP", "CANYON": "CYN", "CAPE": "CPE",
    "CAUSEWAY": "CSWY", "CENTER": "CTR", "CENTERS": "CTRS", "CIRCLE": "CIR", "CIRCLES": "CIRS", "CLIFF": "CLF",
    "CLIFFS": "CLFS", "CLUB": "CLB", "COMMON": "CMN", "CORNER": "COR", "CORNERS": "CORS", "COURSE": "CRSE", "COURT": "CT",
    "COURTS": "CTS", "COVE": "CV", "COVES": "CVS", "CREEK": "CRK", "CRESCENT": "CRES", "CREST": "CRST", "CROSSING": "XING",
    "CROSSROAD": "XRD", "CURVE": "CURV", "DALE": "DL", "DAM": "DM", "DIVIDE": "DV", "DRIVE": "DR", "DRIVES": "DRS",
    "ESTATE": "EST", "ESTATES": "ESTS", "EXPRESSWAY": "EXPY", "EXTENSION": "EXT", "EXTENSIONS": "EXTS", "FALLS": "FLS",
    "FERRY": "FRY", "FIELD": "FLD", "FIELDS": "FLDS", "FLAT": "FLT", "FLATS": "FLTS", "FORD": "FRD", "FORDS": "FRDS",
    "FOREST": "FRST", "FORGE": "FRG", "FORGES": "FRGS", "FORK": "FRK", "FORKS": "FRKS", "FORT": "FT", "FREEWAY": "FWY",
    "GARDEN": "GDN", "GARDENS": "GDNS", "GATEWAY": "GTWY", "GLEN": "GLN", "GLENS": "GLNS", "GREEN": "GRN", "GREENS": "GRNS",
    "GROVE": "GRV", "GROVES": "GRVS", "HARBOR": "HBR", "HARBORS": "HBRS", "HAVEN": "HVN", "HEIGHTS": "HTS", "HIGHWAY": "HWY",
    "HILL": "HL", "HILLS": "HLS", "HOLLOW": "HOLW", "INLET": "INLT", "ISLAND": "IS", "ISLANDS": "ISS", "ISLES": "ISLE",
    "JUNCTION": "JCT", "JUNCTIONS": "JCTS", "KEY": "KY", "KEYS": "KYS", "KNOLL": "KNL", "KNOLLS": "KNLS", "LAKE": "LK",
    "LAKES": "LKS", "LANDING": "LNDG", "LANE": "LN", "LIGHT": "LGT", "LIGHTS": "LGTS", "LOAF": "LF", "LOCK": "LCK",
    "LOCKS": "LCKS", "LODGE": "LDG", "LOOPS": "LOOP", "MANOR": "MNR", "MANORS": "MNRS", "MEADOW": "MDW", "MEADOWS": "MDWS",
    "MILL": "ML", "MILLS": "MLS", "MISSION": "MSN", "MOTORWAY": "MTWY", "MOUNT": "MT", "MOUNTAIN": "MTN",
    "MOUNTAINS": "MTNS", "NECK": "NCK", "ORCHARD": "ORCH", "OVERPASS": "OPAS", "PARKS": "PARK", "PARKWAY": "PKWY",
    "PARKWAYS": "PKWY", "PASSAGE": "PSGE", "PATHS": "PATH", "PIKES": "PIKE", "PINE": "PNE", "PINES": "PNES", "PLACE": "PL",
    "PLAIN": "PLN", "PLAINS": "PLNS", "PLAZA": "PLZ", "POINT": "PT", "POINTS": "PTS", "PORT": "PRT", "PORTS": "PRTS",
    "PRAIRIE": "PR", "RADIAL": "RADL", "RANCH": "RNCH", "RAPID": "RPD", "RAPIDS": "RPDS", "REST": "RST", "RIDGE": "RDG",
    "RIDGES": "RDGS", "RIVER": "RIV", "ROAD": "RD", "ROADS": "RDS", "ROUTE": "RTE", "SHOAL": "SHL", "SHOALS": "SHLS",
    "SHORE": "SHR", "SHORES": "SHRS", "SKYWAY": "SKWY", "SPRING": "SPG", "SPRINGS": "SPGS", "SPURS": "SPUR", "SQUARE": "SQ",
    "SQUARES": "SQS", "STATION": "STA", "STRAVENUE": "STRA", "STREAM": "STRM", "STREET": "ST", "STREETS": "STS",
    "SUMMIT": "SMT", "TERRACE": "TER", "THROUGHWAY": "TRWY", "TRACE": "TRCE", "TRACK": "TRAK", "TRAFFICWAY": "TRFY",
    "TRAIL": "TRL", "TUNNEL": "TUNL", "TURNPIKE": "TPKE", "UNDERPASS": "UPAS", "UNION": "UN", "UNIONS": "UNS", "VALLEY": "VLY",
    "VALLEYS": "VLYS", "VIADUCT": "VIA", "VIEW": "VW", "VIEWS": "VWS", "VILLAGE": "VLG", "VILLAGES": "VLGS", "VILLE": "VL",
    "VISTA": "VIS", "WALKS": "WALK", "WELL": "WL", "WELLS": "WLS",
}

#: Variant spellings of street types, by the abbreviation they stand for.
VARIANTS = {
    "ALY": "ALLEE ALLY", "ANX": "ANEX ANNX", "AVE": "AVEN AVENU AVN AVNUE", "BYU": "BAYOO", "BLF": "BLUF", "BTM": "BOT BOTTM",
    "BLVD": "BOUL BOULV", "BRG": "BRDGE", "BR": "BRNCH", "BYP": "BYPA BYPAS BYPS", "CYN": "CANYN CNYN", "CSWY": "CAUSWAY",
    "CTR": "CEN CENT CENTR CENTRE CNTER CNTR", "CIR": "CIRC CIRCL CRCL CRCLE", "CRK": "CK CR", "CP": "CMP",
    "CRES": "CRECENT CRESENT CRSCNT CRSENT CRSNT", "XING": "CRSSING CRSSNG", "CT": "CRT", "DV": "DIV DVD", "DR": "DRIV DRV",
    "EXPY": "EXP EXPR EXPRESS EXPW", "EXT": "EXTN EXTNSN", "FRST": "FORESTS", "FRG": "FORG", "FWY": "FREEWY FRWAY FRWY", "FRY": "FRRY",
    "FT": "FRT", "GDN": "GARDN GRDEN GRDN", "GTWY": "GATEWY GATWAY GTWAY", "GDNS": "GRDNS", "GRV": "GROV", "HBR": "HARB HARBR HRBOR",
    "HVN": "HAVN", "HTS": "HEIGHT HGTS HT", "HWY": "HIGHWY HIWAY HIWY HWAY", "HOLW": "HLLW HOLLOWS HOLWS", "IS": "ISLND", "ISS": "ISLNDS",
    "JCT": "JCTION JCTN JUNCTN JUNCTON", "JCTS": "JCTNS", "KNL": "KNOL", "LN": "LA LANES", "LDG": "LDGE LODG", "LNDG": "LNDNG",
    "MDWS": "MEDOWS", "MSN": "MISSN MSSN", "MT": "MNT", "MTN": "MNTAIN MNTN MOUNTIN MTIN", "MTNS": "MNTNS", "ORCH": "ORCHRD", "OVAL": "OVL",
    "PKWY": "PARKWY PKWAY PKWYS PKY", "PARK": "PK PRK", "PLNS": "PLAINES", "PLZ": "PLZA", "PR": "PRARIE PRR", "RADL": "RAD RADIEL",
    "RNCH": "RANCHES RNCHS", "RDG": "RDGE", "RIV": "RIVR RVR", "SHR": "SHOAR", "SHRS": "SHOARS", "SPG": "SPNG SPRNG", "SPGS": "SPNGS SPRNGS",
    "SQ": "SQR SQRE SQU", "SQS": "SQRS", "STA": "STATN STN", "ST": "STR STRT", "STRA": "STRAV STRAVE STRAVEN STRAVN STRVN STRVNUE",
    "STRM": "STREME", "SMT": "SUMIT SUMITT", "TER": "TERR", "TPKE": "TPK TRNPK TRPK TURNPK", "TRL": "TR TRAILS TRLS", "TRCE": "TRACES",
    "TRAK": "TRACKS TRK TRKS", "TUNL": "TUNEL TUNLS TUNNELS TUNNL", "VLY": "VALLY VLLY", "VIA": "VDCT VIADCT",
    "VLG": "VILL VILLAG VILLG VILLIAGE", "VIS": "VIST VST VSTA", "WAY": "WY",
}
WORDS |= {word: short for short, words in VARIANTS.items() for word in words.split()}

#: Rewrites applied once each in this order; each acts on the last place where it fits.
REWRITES = (
    (r"^(.*\bI)(\d.*)$", "$1 $2"),
    (r"^(.*\d\s+)\bFWY\b(.*)$", "$1$2"),
    (r"^(.*)\bTRANSIT\s+CTR\b(.*)$", "$1TC$2"),
    (r"^(.*)\bUNITED\s+STATES\b(.*)$", "$1US$2"),
    (r"^(.*)\b(MC|LE)\s+(\S+.*)$", "$1$2$3"),
    (r"^(.*)\b(?:US|OR)\s*(\d.*)$", "$1HWY $2"),
)

#: The tags that hold names, and the one that holds several references.
OSM_NAME_TAGS = ("name", "alt_name", "loc_name", "old_name", "official_name")
OSM_REF_TAG = "ref"


@dataclass(frozen=True)
class CanonConfig:
    """What the canonical form depends on; every part can be replaced."""

    allowed: str = "A-Za-z0-9 "
    ignored: str = "'"
    words: Mapping[str, str] = field(default_factory=lambda: dict(WORDS))
    rewrites: Sequence[tuple[str, str]] = REWRITES

    def with_words(self, more: Mapping[str, str]) -> "CanonConfig":
        """With further word substitutions, e.g. those of another country from a file; they win over the built-in ones."""
        return CanonConfig(self.allowed, self.ignored, {**self.words, **more}, self.rewrites)


DEFAULT = CanonConfig()


def restrict_chars(name: Column, cfg: CanonConfig = DEFAULT) -> Column:
    """Ignored characters vanish, all others that are not allowed become blanks."""
    gone = F.regexp_replace(name, "[" + re.escape(cfg.ignored) + "]", "") if cfg.ignored else name
    return F.regexp_replace(gone, f"[^{cfg.allowed}]", " ")


def collapse_blanks(name: Column) -> Column:
    """Single blanks between words, none at the ends."""
    return F.array_join(F.filter(F.split(name, " "), lambda w: w != ""), " ")


def substitute_words(name: Column, cfg: CanonConfig = DEFAULT) -> Column:
    """Whole-word substitution; a word mapped to nothing disappears. The dictionary is one literal map."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    if not cfg.words:
        return F.array_join(words, " ")
    table = F.create_map(*[F.lit(x) for pair in cfg.words.items() for x in pair])
    return F.array_join(F.filter(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), lambda w: w != ""), " ")


def apply_rewrites(name: Column, cfg: CanonConfig = DEFAULT) -> Column:
    for pattern, into in cfg.rewrites:
        name = F.regexp_replace(name, pattern, into)
    return name


def canonical(name: Column, cfg: CanonConfig = DEFAULT) -> Column:
    """Canonical street name; null stays null, a name without allowed characters becomes ''."""
    return collapse_blanks(apply_rewrites(substitute_words(F.upper(restrict_chars(name, cfg)), cfg), cfg))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; null when a side is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.levenshtein(a, b) / longest)


def match_probability(names1: Column, names2: Column, cfg: CanonConfig | None = DEFAULT) -> Column:
    """Best 1 - ratio over all pairs of two name arrays, canonicalised first unless cfg is None; null without a pair.

    Stays inside the row: no join and no explode.
    """
    if cfg is not None:
        names1, names2 = F.transform(names1, lambda n: canonical(n, cfg)), F.transform(names2, lambda n: canonical(n, cfg))
    return let(names2, lambda others: F.array_max(F.flatten(F.transform(names1, lambda a: F.transform(others, lambda b: 1 - levenshtein_ratio(a, b))))))


def match_score(names1: Column, names2: Column, cfg: CanonConfig | None = DEFAULT) -> Column:
    """match_probability as 0-100, halves up."""
    return F.round(match_probability(names1, names2, cfg) * 100).cast("int")


def canonical_names(names: Column, cfg: CanonConfig = DEFAULT) -> Column:
    """Distinct canonical names of an array, sorted; nulls and empty names are left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: canonical(n, cfg)), lambda n: n.isNotNull() & (n != ""))))


def _empty() -> Column:
    return F.array().cast("array<string>")


def rlis_names(prefix: Column, street: Column, ftype: Column) -> Column:
    """Names of an RLIS street: prefix, name and type; a ramp also has each hyphenated part with and without prefix."""
    before = F.when(prefix != "", F.concat(prefix, F.lit(" "))).otherwise("")
    after = F.when(ftype != "", F.concat(F.lit(" "), ftype)).otherwise("")
    missing = F.coalesce((street == "") | (street == "UNNAMED"), F.lit(True))
    parts = F.filter(F.split(street, "-"), lambda p: (p != "") & (p != "UNNAMED"))
    each = F.flatten(F.transform(parts, lambda p: F.array(F.concat(before, p), p)))
    return F.when(missing, _empty()).when(ftype == "RAMP", F.concat(F.array(F.concat(before, street, after)), each)).otherwise(F.array(F.concat(before, street, after)))


def berkeley_names(fullname: Column, category: Column) -> Column:
    """Names of a Berkeley street: generic labels are none; a highway or connector also has its bare route number.

    'I80 E ...' also gives 'I80', 'HWY 13 N' also 'CA 13'; a null name gives none.
    """
    generic = fullname.contains("UNNAMED") | (fullname == "ALLEY") | ((fullname == "TRAIL") & (category == "PEDESTRIAN")) | ((fullname == "RAMP") & (category == "CONNECTOR"))
    words = F.split(fullname, " ")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    positive = "^[+]?0*[1-9][0-9]*$"
    route = F.when(first.rlike(positive.replace("^", "^I")), first).when((first == "HWY") & second.rlike(positive), F.concat(F.lit("CA "), second))
    extra = F.when(category.isin("CONNECTOR", "HIGHWAY") & (F.size(words) > 1) & route.isNotNull(), F.array(route)).otherwise(_empty())
    return F.when(fullname.isNull() | F.coalesce(generic, F.lit(False)), _empty()).otherwise(F.concat(F.array(fullname), extra))


def osm_names(tags: Column) -> Column:
    """Names of an OSM way: its name tags, and the references of `ref`, which ';' separates."""
    named = F.filter(F.array(*[F.element_at(tags, k) for k in OSM_NAME_TAGS]), lambda n: n.isNotNull())
    refs = F.coalesce(F.split(F.element_at(tags, OSM_REF_TAG), ";"), F.array().cast("array<string>"))
    return F.concat(named, refs)


def html_escape(text: Column) -> Column:
    """& < > as entities; quotes stay."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
