"""Default word lists and patterns; every operator takes its own instead.

Fixed values: the results depend on them letter by letter.
"""

#: Ordered (pattern, society); the first pattern that matches anywhere wins.
SOCIETY_PATTERNS = [
    (r"\bDNV\b", "DNV"),
    (r"\bABS\b", "ABS"),
    (r"\bCCS\b", "CCS"),
    (r"\bLR\b|Lloyd'?s\s+Register", "LR"),
    (r"\bBV\b|Bureau\s+Veritas", "BV"),
    (r"\bNK\b|Nippon\s+Kaiji\s+Kyokai", "NK"),
    (r"\bRINA\b|Registro\s+Italiano\s+Navale", "RINA"),
    (r"\bKR\b|Korean\s+Register", "KR"),
    (r"\bIMO\b", "IMO"),
    (r"\bIACS\b", "IACS"),
]
#: Order in which a query is searched for societies.
SOCIETIES = ["DNV", "ABS", "CCS", "LR", "BV", "RINA", "NK", "KR", "IACS", "IMO"]
YEAR = r"(20\d{2}|19\d{2})"
CHAPTER = r"(Pt\.?\s*\d+(\s*Ch\.?\s*\d+)?)|(Part\s+\d+[A-Z]?\s*Section\s*[\d-]+)|(第\s*\d+\s*章)|(Chapter\s+\d+)|(§\s*[\d.]+)"
STEEL_GRADE = r"\b[A-Z]{2,4}\d{2,3}\b"
TEMPERATURE = r"\d{2,4}\s*[°º]?\s*[CF]\b"
EXACT_CODE = r"^[A-Z]{2,6}-[A-Za-z0-9-]+$"
CLAUSES = [
    r"(?i)\b(?:Part|Pt)\.?\s*\d+\s*(?:Chapter|Ch)\.?\s*\d+\b",
    r"(?i)\b(?:Part|Pt)\.?\s*\d+\s*§\s*[\d.]+\b",
    r"(?i)\b(?:Chapter|Ch)\.?\s*\d+\s*§\s*[\d.]+\b",
    r"(?i)\b(?:Part|Pt)\.?\s*\d+\b",
    r"(?i)\b(?:Chapter|Ch)\.?\s*\d+\b",
    r"§\s*[\d.]+",
    r"(?i)\bSection\s+[\d.]+\b",
]
EQUIPMENT = r"(?i)\b(?:Type|Model)\s*[-:]\s*[A-Za-z0-9]+"
PARAMETERS = [r"\b\d{2,4}\s*(?:°\s*)?[CF]\b", r"\b\d+(?:\.\d+)?\s*mm\b", r"\b\d+(?:\.\d+)?\s*MPa\b"]
NEGATIONS = [r"(?i)except\s+([^.]+)", r"(?i)excluding\s+([^.]+)", r"(?i)not applicable to\s+([^.]+)", r"(?i)does not apply to\s+([^.]+)"]
#: Lower-cased words to canonical names, in order.
SHIP_TYPES = {
    "bulk carrier": "bulk carrier", "ore carrier": "ore carrier", "oil tanker": "oil tanker", "crude oil tanker": "crude oil tanker",
    "product tanker": "product tanker", "chemical tanker": "chemical tanker", "container ship": "container ship",
    "lng carrier": "LNG carrier", "lpg carrier": "LPG carrier", "passenger ship": "passenger ship", "cruise ship": "cruise ship",
    "ferry": "ferry", "ro-ro": "Ro-Ro", "ropax": "RoPax", "general cargo ship": "general cargo ship",
    "multi-purpose vessel": "multi-purpose vessel", "offshore supply vessel": "offshore supply vessel", "osv": "OSV", "psv": "PSV",
    "ahts": "AHTS", "tug boat": "tug boat", "tug": "tug", "barge": "barge", "fishing vessel": "fishing vessel", "trawler": "trawler",
    "drillship": "drillship", "semi-submersible": "semi-submersible", "jack-up rig": "jack-up rig", "fpso": "FPSO", "fsru": "FSRU",
    "flng": "FLNG", "heavy lift vessel": "heavy lift vessel", "cable laying ship": "cable laying ship",
    "pipe laying vessel": "pipe laying vessel", "dredger": "dredger", "icebreaker": "icebreaker", "research vessel": "research vessel",
    "patrol vessel": "patrol vessel", "naval vessel": "naval vessel", "yacht": "yacht",
}
#: Deep, scope and domain words of a query; the first list of each is matched as it stands, the second as lower-cased words.
DEEP = (["为什么", "如何", "原因", "区别", "对比", "分析"], ["why", "how", "cause", "difference", "compare", "analysis"])
SCOPE = (["全面分析", "总结", "所有", "完整", "系统", "综述"], ["comprehensive", "summary", "all", "complete", "systematic", "overview"])
DOMAIN = (["疲劳", "焊接", "NDT", "有限元", "屈曲", "稳性", "腐蚀"], ["fatigue", "welding", "ndt", "finite element", "buckling", "stability", "corrosion"])
#: Numeric requirements: parameter and value, parameter and value, value and unit.
REQUIREMENTS = [
    r"(强度|板厚|系数|间距|温度|压力|速度|厚度|距离|高度)\s*[≥≤⩾⩼>=<]+\s*([\d.]+)",
    r"(?i)(strength|thickness|factor|spacing|temperature|pressure|velocity|distance|height|depth).*?(?:>=|≤|>=|<=|minimum|maximum|not less than|not more than)\s*([\d.]+)",
    r"(?i)(?:not\s+less\s+than|minimum|at\s+least)\s+([\d.]+)\s*(mm|MPa|kN|m|cm|°C|deg)?",
]
PARAMETER_NAMES = {"强度": "strength", "板厚": "thickness", "系数": "factor", "间距": "spacing", "温度": "temperature", "压力": "pressure", "速度": "velocity", "厚度": "thickness", "距离": "distance", "高度": "height"}
SYNONYMS = {
    "welding": ["weld", "fusion", "joining"],
    "preheat": ["pre-heat", "heating"],
    "thickness": ["plate thickness", "material thickness"],
    "requirement": ["criteria", "specification", "standard"],
}
#: First bytes in hex, in order, to a format; null leaves it to the extension.
MAGIC = [
    (b"%PDF-", "pdf"), (b"\x89PNG", "image"), (b"\xff\xd8\xff", "image"), (b"II*\x00", "image"), (b"MM\x00*", "image"), (b"BM", "image"), (b"PK\x03\x04", None),
    (b"<!DOCTYP", "html"), (b"<html", "html"),
]
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "html": "html", "htm": "html", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "tif": "image", "bmp": "image", "csv": "csv", "md": "markdown"}
PERMISSIONS = {"viewer": ["read", "comment"], "editor": ["read", "comment", "write"], "owner": ["read", "comment", "write", "admin"]}
TEMPLATES = {
    "bulk_carrier_dnv": ["DNV Pt.1 Ch.1", "DNV Pt.3 Ch.4", "DNV Pt.5 Ch.5", "IACS UR S11", "IACS UR S21", "MARPOL Annex VI"],
    "lng_carrier_dnv": ["DNV Pt.5 Ch.5", "DNV Pt.5 Ch.6", "IGC Code", "IGF Code"],
    "tanker_dnv": ["DNV Pt.3 Ch.4", "DNV Pt.5 Ch.5", "MARPOL Annex I"],
    "container_dnv": ["DNV Pt.3 Ch.4", "DNV Pt.5 Ch.5", "IACS UR S11A"],
    "offshore_dnv": ["DNV-ST-0126", "DNV-RP-C203", "ISO 19902"],
}
#: Our own stop words for language votes.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "on", "this", "are", "be", "from", "by", "as", "at"],
    "fr": ["de", "la", "le", "les", "et", "des", "un", "une", "du", "dans", "qui", "que", "pour", "par", "sur", "au", "elle", "avec", "est"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "sch"],
    "es": ["de", "la", "que", "el", "en", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
}
