"""Word lists and patterns of record normalization.

Fixed values: results depend on exactly these entries.
"""

# Stop words of the first blocking generation, of the second, and of the keyword picker.
STOP_V1 = ["inc", "corp", "corporation", "llc", "ltd", "limited", "pvt", "private", "co", "company", "and", "the", "of", "in", "near", "at", "on", "by", "services"]
STOP_V2 = [*STOP_V1, "sa", "sas", "sarl", "gmbh"]
STOP_KEYWORD_V1 = ["inc", "corp", "corporation", "llc", "ltd", "limited", "pvt", "private", "co", "company", "and", "the", "of", "in", "near"]
STOP_KEYWORD_V2 = STOP_V1

# Patterns (Java flavour).
POSSESSIVE = "['’]s\\b"
NOT_WORD_V1 = "[^a-z0-9ऀ-ॿÀ-ſ]+"
NOT_WORD_V2 = r"[^\p{L}\p{N}_\s]+"
WEB_PARTS = r"https?://\S+|www\.\S+|\.(com|in|org|net|co|io)\b"
TOP_DOMAIN = r"\.(com|in|org|net|co|io)\b"
TRADE_NAMES = [r"\bd/?b/?a\b", r"\bt/?a\b", r"\btrading as\b", r"\bdoing business as\b", r"\bc/?o\b", r"\baka\b"]
POSTAL = r"\b\d{5,6}\b"
BUILDING = r"\b\d+[/a-zA-Z0-9-]*\b"
INDIC = "[ऀ-෿]"
INDIC_RUN = "[ऀ-෿][ऀ-෿‌‍ ]*"
ALIAS = r"\b(?:dba|d b a|doing business as|trading as|aka|a k a|fka|f k a|formerly known as|formerly)\b"
WEBSITE = r"(?i)(?:www\.|https?://|\.(?:com|net|org|biz|info|in|fr|co)\b)"
WEBSITE_ENDS = r"^(?:https?\s)?www\s|\s(?:com|net|org|biz|info|in|fr|co)(?:\s(?:in|uk))?$"
HONORIFIC = r"^(?:(?:m s|mr|mrs|ms|smt|dr|sri|shri)\s+)+(?=\S)"
MISSING_WORDS = r"\b(?:null|none|nan|n a)\b"

# Rewrites of the phonetic skeleton, in this order.
PHONETIC = [("ksh", "ks"), ("x", "ks"), ("sh", "s"), ("ch", "c"), ("ck", "k"), ("ph", "f"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("w", "v"), ("z", "j"), ("q", "k")]

NAME_WORDS = {
    "corp": "corporation", "co": "company", "pvt": "private", "ltd": "limited", "intl": "international", "mfg": "manufacturing", "svcs": "services", "svc": "service", "bros": "brothers", "assoc": "associates", "mgmt": "management", "ent": "enterprises", "ind": "industries", "natl": "national", "cie": "compagnie", "praivet": "private", "elelpi": "llp", "limitid": "limited", "pvtltd": "private limited",
}
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "ln": "lane", "dr": "drive", "ct": "court", "hwy": "highway", "pkwy": "parkway", "sq": "square", "apt": "apartment", "ste": "suite", "fl": "floor", "flr": "floor", "bldg": "building", "opp": "opposite", "nr": "near", "sec": "sector", "ph": "phase", "dist": "district", "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "pl": "place", "ch": "chemin", "imp": "impasse", "rte": "route", "fg": "faubourg", "mt": "mount", "ctr": "center", "centre": "center", "twp": "township", "terr": "terrace", "ter": "terrace", "cir": "circle", "pk": "park", "sqr": "square",
}
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "district of columbia": "dc", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "tamilnadu": "tn", "tmilnatu": "tn", "telangana": "tg", "ts": "tg", "tripura": "tr", "uttar pradesh": "up", "uttr prdes": "up", "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "jammu and kashmir": "jk", "ladakh": "la", "puducherry": "py", "pondicherry": "py", "chandigarh": "ch", "delhi": "dl",
}
LEGAL = ["inc", "incorporated", "llc", "llp", "ltd", "limited", "private", "pvt", "corporation", "corp", "company", "co", "plc", "lp", "pc", "pllc", "opc", "sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "scop", "gmbh", "ag", "bv", "nv", "pte", "pty", "srl", "spa", "societe", "compagnie", "the", "and", "of", "et", "de", "la", "le", "les", "du", "des", "d", "l"]
