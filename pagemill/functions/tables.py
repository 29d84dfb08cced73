"""Tables and word lists that must equal the published behaviour for equal results."""

from __future__ import annotations

# Prefixes of normalised legacy font names, their family and language, in order of precedence.
FONT_FAMILIES = (
    ("fmabhaya", "fm-abhaya", "si"), ("fmabaya", "fm-abhaya", "si"), ("fmabab", "fm-abhaya", "si"),
    ("fmbindumathi", "fm-bindumathi", "si"), ("fmmalithi", "fm-malithi", "si"), ("fmderana", "fm-derana", "si"),
    ("fmemanee", "fm-emanee", "si"), ("fmganganee", "fm-ganganee", "si"), ("fmsamantha", "fm-samantha", "si"),
    ("fmarjun", "fm-arjunn", "si"), ("fmbasuru", "fm-basuru", "si"), ("fmgemunu", "fm-gemunu", "si"),
    ("fmrashmi", "fm-rashmi", "si"), ("fmsandhyanee", "fm-sandhyanee", "si"), ("fmpodiyan", "fm-podiyan", "si"),
    ("fmmadhura", "fm-madhura", "si"), ("fmsamanthax", "fm-samantha", "si"), ("dlmanel", "dl-manel", "si"),
    ("dlparas", "dl-paras", "si"), ("dlaraliya", "dl-araliya", "si"), ("dlhimaya", "dl-himaya", "si"),
    ("dlsarasavi", "dl-sarasavi", "si"), ("dlyasarasi", "dl-yasarasi", "si"), ("kaputa", "kaputa", "si"),
    ("thibus", "thibus", "si"), ("amalee", "amalee", "si"), ("sandaya", "sandaya", "si"),
    ("wijaya", "wijaya", "si"), ("isiwara", "isi", "si"), ("kandy", "kandy", "si"),
    ("bamini", "bamini", "ta"), ("baamini", "bamini", "ta"), ("vanavil", "vanavil", "ta"),
    ("kalaham", "kalaham", "ta"), ("amudham", "amudham", "ta"), ("kalaimakal", "kalaimakal", "ta"),
    ("shreetam", "shree-tam", "ta"), ("elango", "elango", "ta"), ("mylai", "mylai", "ta"),
    ("tamtam", "tam", "ta"), ("tscu", "tscii", "ta"), ("tscii", "tscii", "ta"),
)

# FM Abhaya code sequences and the Sinhala text, in visual order, that they draw.
FM_ABHAYA = {
    "!": "ෟ", "\u0022": ",", "$": "/", "%": "්\u200dර", "&": ")", "'": ".", "(": ":", "*": "ෆ",
    "+": "ූ", ",": "ල", "-": "-", ".": "ග", "/": "රැ", "0": "0", "1": "1", "2": "2",
    "3": "3", "4": "4", "5": "5", "6": "6", "7": "7", "8": "8", "9": "9", ":": "ථ",
    ";": "ත", "<": "ළ", "=": "ු", ">": "ඝ", "@": "?", "A": "්", "B": "ඊ", "C": "ක්\u200d",
    "D": "ෘ", "DD": "ෲ", "E": "ෑ", "G": "ඨ", "H": "්\u200dය", "I": "ෂ", "K": "ණ", "L": "ඛ",
    "M": "ඵ", "N": "භ", "O": "ධ", "P": "ඡ", "Q": "ූ", "S": "ී", "T": "ඔ", "T!": "ඖ",
    "TA": "ඕ", "Ta": "ඕ", "U": "ඹ", "W": "උ", "Y": "ශ", "Z": "’", "ZZ": "”", "[": "ඤ",
    "^": "(", "`.": "ඟ", "`o": "ඳ", "`v": "ඬ", "a": "්", "b": "ඉ", "c": "ජ", "d": "ා",
    "e": "ැ", "f": "ෙ", "g": "ට", "h": "ය", "i": "ස", "j": "ව", "k": "න", "l": "ක",
    "m": "ප", "n": "බ", "o": "ද", "p": "ච", "q": "ු", "r": "ර", "rE": "රූ", "re": "රු",
    "s": "ි", "t": "එ", "tA": "ඒ", "ta": "ඒ", "u": "ම", "v": "ඩ", "w": "අ", "wE": "ඈ",
    "wd": "ආ", "we": "ඇ", "x": "ං", "y": "හ", "z": "‘", "zz": "“", "{": "ඥ", "|": "ඳ",
    "~": "ඬ", "¡": ".", "¢": "ඳි", "¥": "දූ", "¦": ";", "§": "දී", "¨": "ලු", "±": "දැ",
    "´": "ඕ", "¾": "ර්", "¿": "ළු", "Å": "ඛි", "Æ": "ලූ", "È": "දි", "É": "ච්", "Ê": "ජ්",
    "Ë": "ක්\u200dෂ", "Í": "රී", "Ñ": "චි", "Ñs": "චි", "Ó": "ථි", "Ô": "ජී", "Õ": "ඟ", "Ö": "චී",
    "×": "ඥා", "Ü": "ට්", "Þ": "දා", "ß": "රි", "à": "ටී", "á": "ටි", "â": "ඩ්", "ã": "ඩී",
    "ä": "ඩි", "ê": "ධි", "ë": "ධී", "ì": "බි", "í": "බ්", "î": "බී", "ï": "ම්", "ð": "ජි",
    "ñ": "මි", "ó": "මී", "õ": "ව්", "÷": "ඳු", "ø": "ද්\u200dර", "ù": "වී", "ú": "වි", "ý": "ඡි",
    "þ": "ඡ", "ÿ": "දු", "Œ": "ණී", "˜": "”", "—": "“", "‚": "ණි", "›": "ශ්\u200dරී",
}

# Sinhala recognition confusions as read, as printed, and weight.
SINHALA_CONFUSIONS = (
    ("ත", "න", 0.216), ("ච", "ව", 0.666), ("න", "ත", 0.108), ("ී", "ි", 0.040), ("ම", "ම්", 0.015),
    ("ඳු", "ඳ", 0.598), ("ූ", "ු", 0.186), ("ෙ", "ේ", 0.044), ("නූ", "තු", 0.824), ("එ", "ඒ", 0.108),
    ("දු", "ද", 0.229), ("්", "ී", 0.004), ("ර", "රි", 0.005), ("ි", "්", 0.004), ("ත", "තු", 0.005),
    ("ත", "ති", 0.004), ("ක", "කි", 0.004), ("ඟ", "ග", 0.263), ("ා", "්\u200dය", 0.004), ("ග", "ශ", 0.015),
    ("චන", "වත", 0.230), ("ත", "නි", 0.003), ("්", "ි", 0.003), ("ෙත", "ේන", 0.112), ("ත්", "නී", 0.009),
    ("භ", "හ", 0.127), ("ට", "ව", 0.011), ("න", "හ", 0.003), ("ර", "ප", 0.002), ("ි", "ී", 0.002),
    ("ු", "ූ", 0.004), ("ුන", "හ", 0.073), ("න", "නි", 0.002), ("හ", "ග", 0.006), ("හ", "ඟ", 0.006),
    ("ැ", "ු", 0.007), ("ට", "ට්", 0.005), ("ත", "ින", 0.001), ("ප", "ස", 0.003), ("ීත", "ින", 0.133),
    ("ු", "්\u200dර", 0.003), ("ෟ", "්\u200dය", 0.545), ("ග", "ගු", 0.005), ("තන", "ත", 0.093), ("දා", "ද", 0.050),
    ("ො", "ෙ", 0.023), ("ඈ", "ඇ", 1.000), ("චත", "වන", 0.125), ("ත", "හ", 0.001), ("තන", "නත", 0.074),
    ("ද", "ඳ", 0.003), ("න", "ශ", 0.001), ("ඳා", "ඳ", 0.800), ("ය", "යා", 0.001), ("ලු", "ල", 0.091),
    ("වච", "ව", 0.800), ("ීන", "ිත", 0.364), ("ුස", "්\u200dය", 0.267),
)

# English function words.
FUNCTION_WORDS = (
    "the of and to in a is that for by be or as on with any shall this which under such are it from at an not was has have been other may no all his her its their"
).split()

# Symbols that legacy fonts put inside words.
INNER_SYMBOLS = "%;,'[]^$|`~@&*=+\\{}#"

# Parts of font names that mean a Latin font.
LATIN_FONTS = "times arial helvetica calibri cambria verdana georgia garamond minion courier tahoma book".split()

# File extensions.
OFFICE_EXTENSIONS = "doc docx docm odt ppt pptx pptm pps ppsx odp xls xlsx xlsm xlsb ods rtf epub csv".split()
IMAGE_EXTENSIONS = "png jpg jpeg tif tiff bmp webp gif jp2 pnm pbm pgm ppm".split()

# HTML elements dropped with their content, and those that start a block.
HTML_SKIPPED = "script style noscript nav header footer aside form button iframe svg head template select input canvas object embed".split()
HTML_BLOCKS = "p div section article main body html center figure figcaption dl dt dd address details summary font".split()
