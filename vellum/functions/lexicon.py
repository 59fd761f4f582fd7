"""Word lists of the domain: 17th-century English and Irish names, places and spellings."""

from __future__ import annotations

# Prefixes of names.
PREFIXES = ("o", "ó", "o'", "ó'", "mac", "mc", "mag", "nic", "ní", "nicol", "mcg", "mhic", "uig", "ui", "ua")
# Surnames.
SURNAMES = (
    "shea", "sheehan", "oshea", "o'shea", "shee", "sheaf", "murphy", "o'murphy", "murphey", "kelly", "kelley", "walsh", "welsh", "byrne", "burne", "o'byrne", "ryan", "o'brien", "o'neill", "o'bryan",
    "o'malley", "omalley", "mallie", "sullivan", "o'sullivan", "kennedy", "nolan", "lyons", "connolly", "connelly", "kavanagh", "cavanagh", "caomhánach", "mccarthy", "macarthy", "fitzgerald", "higgins", "flynn", "doyle", "quinn",
    "whelan", "healy", "o'neill", "oneill", "o'rourke", "o'connor", "oconnor", "maguire", "mcguire", "neill",
)
# First names.
FIRST_NAMES = (
    "aoife", "niamh", "saoirse", "sinead", "eoin", "sean", "séan", "ciaran", "ciarán", "padraig", "pádraig", "padraic", "maire", "máire",
    "molly", "brigid", "bríd", "Jane"
)
# Places.
PLACE_NAMES = (
    "ulster", "munster", "leinster", "connacht", "derry", "armagh", "tyrone", "cavan", "donegal", "antrim", "down", "fermanagh", "monaghan", "louth", "meath", "westmeath", "longford", "kildare", "offaly", "laois",
    "wicklow", "dublin", "kilkenny", "carlow", "wexford", "waterford", "tipperary", "cork", "kerry", "limerick", "clare", "galway", "roscommon", "mayo", "sligo", "leitrim", "athlone", "clonmel", "cashel", "lismore",
    "naas", "trim", "navan", "nenagh", "drogheda", "dundalk", "kilrush", "ennis", "kells", "skerries", "youghal", "ballycastle", "ballymena", "coleraine", "castlereagh", "cookstown", "clones", "newcastle", "oldcastle", "croom", "castlebar",
)
# Counties.
COUNTIES = (
    "antrim", "armagh", "carlow", "cavan", "clare", "cork", "derry", "donegal", "down", "dublin", "fermanagh", "galway", "kerry", "kildare", "kilkenny", "laois", "leitrim", "limerick", "longford", "louth", "mayo", "meath",
    "monaghan", "offaly", "roscommon", "sligo", "tipperary", "tyrone", "waterford", "westmeath", "wexford", "wicklow",
)
# Old spellings of places.
PLACE_SPELLINGS = {
    "vlster": "ulster", "mounster": "munster", "connaght": "connacht", "limrick": "limerick", "armaghe": "armagh", "tirone": "tyrone", "ffermannagh": "fermanagh", "meath": "meath", "flaunders": "flanders", "dublinne": "dublin",
    "cashell": "cashel", "cittie": "city", "dunnigall": "donegal", "ardmagh": "armagh", "engeland": "england",
}
# Old spellings of words.
OVERRIDES = {
    "accompt": "account", "payd": "paid", "paide": "paid", "payde": "paid", "paydeth": "paid", "citty": "city", "sayd": "said", "sayed": "said", "sayde": "said", "yr": "your", "yne": "one", "moneth": "month",
    "moneths": "months", "maiesties": "majesties", "lojall": "loyal", "beeinge": "being", "beeing": "being", "beinge": "being", "vniuersitie": "university", "vniuersity": "university", "vniversitie": "university", "receypt": "receipt",
    "receipte": "receipt", "recceypt": "receipt", "ffycche": "office", "fycche": "office", "fycchehouse": "officehouse", "doe": "do", "doeth": "does", "doth": "does", "hath": "has", "hathh": "has", "gaue": "gave", "giue": "give",
    "giuen": "given", "giueth": "gives", "giuing": "giving", "haue": "have", "hauing": "having", "haueing": "having", "bee": "be", "beene": "been", "bene": "been", "erle": "earl", "neale": "neill", "neal": "neill", "o neale": "o'neill",
    "oneale": "o'neill", "wereof": "whereof", "againe": "again", "againest": "against", "magwyre": "maguire", "agayne": "again", "neere": "near", "neare": "near", "faileth": "fails", "faile": "fail", "wyll": "will", "wylling": "willing",
    "vvill": "will", "shoulde": "should", "woulde": "would", "coulde": "could", "oldde": "old", "olde": "old", "oge": "óg", "heere": "here", "thereofe": "thereof", "hereofe": "hereof", "shal": "shall", "shalle": "shall", "yeres": "years",
    "widdow": "widow", "summe": "sum",
}
# Provinces.
PROVINCES = ("ulster", "munster", "leinster", "connacht", "connaught")
# Words near persons.
PERSON_TITLES = (
    "mr", "mrs", "sir", "lord", "lady", "bishop", "doctor", "dr", "esquire", "esqr", "primate", "friar", "preist", "abbot", "earle", "erle",
    "duke", "count", "cardinal"
)
# Words near places.
PLACE_CUES = (
    "in", "at", "near", "towne", "city", "citty", "county", "province", "kingdome", "kingdom", "sea", "river", "castle", "estate",
    "convent", "abbey"
)
# Phrases that are no entity.
STOP_PHRASES = ("County of", "City of", "County", "City", "Proportion of", "county")
# Words of place types.
TYPE_KEYWORDS = ("county", "city", "citty", "town", "towne", "parish", "barony", "province", "prouince")
# Eras.
EARLY_MODERN, MODERN, PRESENT = "early-modern-1500-1749", "modern-1750-1922", "present-day"
