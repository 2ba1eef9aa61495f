"""Category rules, policies, labels, icons and word lists.

Everything in this file is data that results depend on, stated as it must be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: categories in rank order ---------------------------------
# (category, on by default, text colour, background colour, [(key, value, icon)])
CATEGORIES: list[tuple[str, bool, str, str, list[tuple[str, str, str]]]] = [
    ("Water", True, "#FFFFFF", "#0066CC", [
        ("amenity", "water_point", "droplet"), ("amenity", "drinking_water", "droplet"),
    ]),
    ("Sleeping place", True, "#FFFFFF", "#1A1A2E", [
        ("tourism", "camp_site", "tent"), ("tourism", "hostel", "bed"),
        ("tourism", "alpine_hut", "house"), ("tourism", "chalet", "house"),
        ("tourism", "guest_house", "bed"), ("tourism", "motel", "bed"), ("tourism", "hotel", "bed"),
    ]),
    ("Restroom", True, "#000000", "#FFD700", [
        ("amenity", "toilets", "restroom"), ("amenity", "shower", "shower"),
    ]),
    ("Shelter", True, "#FFFFFF", "#444444", [("amenity", "shelter", "house")]),
    ("Food shop", True, "#FFFFFF", "#228B22", [
        ("shop", "supermarket", "cart"), ("shop", "convenience", "store"), ("shop", "bakery", "bread"),
        ("shop", "butcher", "meat"), ("shop", "greengrocer", "carrot"), ("shop", "farm", "tractor"),
        ("shop", "food", "apple"), ("shop", "deli", "store"), ("shop", "cheese", "cheese"),
        ("shop", "pastry", "cookie"), ("shop", "seafood", "fish"), ("shop", "alcohol", "wine"),
        ("shop", "beverages", "cup"), ("shop", "frozen_food", "snowflake"),
        ("shop", "health_food", "leaf"), ("shop", "water", "droplet"), ("shop", "wine", "wine"),
        ("shop", "coffee", "coffee"), ("shop", "tea", "cup"), ("shop", "chocolate", "candy"),
        ("shop", "confectionery", "candy"), ("shop", "dairy", "cheese"),
        ("shop", "ice_cream", "icecream"), ("shop", "nuts", "seed"), ("shop", "pasta", "wheat"),
        ("shop", "spices", "leaf"), ("shop", "brewing_supplies", "beer"), ("shop", "tortilla", "bread"),
    ]),
    ("Restaurant or Bar", True, "#FFFFFF", "#FF6B35", [
        ("amenity", "restaurant", "utensils"), ("amenity", "cafe", "coffee"),
        ("amenity", "fast_food", "burger"), ("amenity", "bar", "beer"), ("amenity", "pub", "beer"),
        ("amenity", "biergarten", "beer"), ("amenity", "food_court", "utensils"),
        ("amenity", "ice_cream", "icecream"),
    ]),
    ("Gears", True, "#FFFFFF", "#CC0000", [
        ("shop", "bicycle", "bicycle"), ("shop", "outdoor", "backpack"), ("shop", "sports", "dumbbell"),
    ]),
    ("DIY", True, "#FFFFFF", "#E65100", [("amenity", "bicycle_repair_station", "wrench")]),
    ("Laundry", True, "#FFFFFF", "#FFB6C1", [("shop", "laundry", "shirt")]),
    ("Medical", False, "#FFFFFF", "#DC2626", [
        ("amenity", "hospital", "hospital"), ("amenity", "clinic", "hospital"),
        ("amenity", "doctors", "stethoscope"), ("amenity", "dentist", "tooth"),
        ("amenity", "veterinary", "paw"),
    ]),
    ("Pharmacy", False, "#FFFFFF", "#16A34A", [("amenity", "pharmacy", "pills")]),
    ("Bank & ATM", False, "#FFFFFF", "#1D4ED8", [
        ("amenity", "atm", "creditcard"), ("amenity", "bank", "bank"),
        ("amenity", "bureau_de_change", "exchange"),
    ]),
    ("Post office", False, "#FFFFFF", "#CA8A04", [
        ("amenity", "post_office", "envelope"), ("amenity", "post_box", "mailbox"),
    ]),
    ("Viewpoint", False, "#FFFFFF", "#7C3AED", [
        ("tourism", "viewpoint", "eye"), ("tourism", "attraction", "star"),
        ("tourism", "museum", "landmark"), ("historic", "castle", "castle"),
        ("historic", "monument", "monument"), ("historic", "memorial", "monument"),
        ("historic", "ruins", "ruin"),
    ]),
    ("Tourist info", False, "#000000", "#38BDF8", [
        ("tourism", "information", "info"), ("information", "office", "info"),
    ]),
    ("Charging", False, "#000000", "#FACC15", [
        ("amenity", "charging_station", "bolt"), ("amenity", "device_charging_station", "battery"),
    ]),
    ("Picnic", False, "#FFFFFF", "#059669", [
        ("tourism", "picnic_site", "tree"), ("leisure", "picnic_table", "table"), ("amenity", "bbq", "fire"),
    ]),
    ("Wifi", False, "#FFFFFF", "#6366F1", [
        ("amenity", "internet_cafe", "wifi"), ("internet_access", "wlan", "wifi"), ("amenity", "library", "book"),
    ]),
]

# --- Fixed values: categories whose places are never merged -----------------
NEVER_MERGED = [
    "Restaurant or Bar", "Food shop", "Sleeping place", "Gears", "Medical", "Pharmacy",
    "Bank & ATM", "Post office", "Tourist info",
]

# --- Fixed values: how much enrichment a category deserves -------------------
POLICY = {
    "Restaurant or Bar": "full", "Food shop": "full", "Sleeping place": "full", "Gears": "full",
    "Laundry": "minimal", "DIY": "minimal", "Medical": "minimal", "Pharmacy": "minimal",
    "Bank & ATM": "minimal", "Post office": "minimal", "Tourist info": "minimal",
    "Viewpoint": "minimal", "Charging": "minimal", "Wifi": "minimal",
    "Water": "skip", "Restroom": "skip", "Shelter": "skip", "Picnic": "skip",
}

# --- Fixed values: OsmAnd icons, by category and by tag ----------------------
OSMAND_ICON = {
    "Water": "amenity_drinking_water", "Sleeping place": "tourism_camp_site",
    "Restroom": "amenity_toilets", "Shelter": "amenity_shelter", "Food shop": "shop_supermarket",
    "Restaurant or Bar": "amenity_restaurant", "Gears": "shop_bicycle",
    "DIY": "amenity_bicycle_repair_station", "Laundry": "shop_laundry",
    "Medical": "amenity_hospital", "Pharmacy": "amenity_pharmacy", "Bank & ATM": "amenity_atm",
    "Post office": "amenity_post_office", "Viewpoint": "tourism_viewpoint",
    "Tourist info": "tourism_information", "Charging": "amenity_charging_station",
    "Picnic": "tourism_picnic_site", "Wifi": "amenity_internet_cafe",
}
OSMAND_ICON_FALLBACK = "special_star"
# Tags whose icon is named key_value.
_OSMAND_PLAIN = {
    "amenity": [
        "drinking_water", "toilets", "shower", "shelter", "restaurant", "cafe", "fast_food", "bar",
        "pub", "biergarten", "ice_cream", "bicycle_repair_station", "hospital", "clinic", "doctors",
        "pharmacy", "atm", "bank", "post_office", "charging_station", "internet_cafe", "library",
    ],
    "tourism": [
        "camp_site", "hostel", "alpine_hut", "hotel", "guest_house", "chalet", "viewpoint",
        "attraction", "museum", "information", "picnic_site",
    ],
    "shop": ["supermarket", "convenience", "bakery", "butcher", "bicycle", "outdoor", "sports", "laundry"],
    "leisure": ["picnic_table"],
}
OSMAND_TAG_ICON = {f"{k}={v}": f"{k}_{v}" for k, values in _OSMAND_PLAIN.items() for v in values}
OSMAND_TAG_ICON["amenity=water_point"] = "amenity_drinking_water"
OSMAND_TAG_ICON["tourism=motel"] = "tourism_hotel"
OSMAND_COLOUR_FALLBACK = "#3b82f6"
OSMAND_BACKGROUND = {
    "Shelter": "octagon", "Viewpoint": "octagon", "Gears": "square", "DIY": "square",
    "Medical": "square", "Charging": "square",
}
OSMAND_BACKGROUND_FALLBACK = "circle"

# --- Fixed values: GPX symbols -----------------------------------------------
GPX_SYMBOL = {
    "Water": "Drinking Water", "Sleeping place": "Campground", "Restroom": "Restroom",
    "Shelter": "Shelter", "Food shop": "Shopping Center", "Restaurant or Bar": "Restaurant",
    "Gears": "Bike Trail", "DIY": "Wrecker", "Laundry": "Building", "Medical": "Medical Facility",
    "Pharmacy": "Pharmacy", "Bank & ATM": "Bank", "Post office": "Post Office",
    "Viewpoint": "Scenic Area", "Tourist info": "Information", "Charging": "Charging Station",
    "Picnic": "Picnic Area", "Wifi": "Library",
}
GPX_SYMBOL_FALLBACK = "Flag, Blue"

# --- Fixed values: labels ------------------------------------------------------
CATEGORY_LABEL = {
    "en": {"Gears": "Bike & Sport", "DIY": "Bike repair"},
    "fr": {
        "Water": "Eau", "Sleeping place": "Hébergement", "Restroom": "Toilettes", "Shelter": "Abri",
        "Food shop": "Alimentation", "Restaurant or Bar": "Restaurant / Bar", "Gears": "Vélo & Sport",
        "DIY": "Réparation vélo", "Laundry": "Laverie", "Medical": "Médical", "Pharmacy": "Pharmacie",
        "Bank & ATM": "Banque & DAB", "Post office": "Poste", "Viewpoint": "Point de vue",
        "Tourist info": "Info tourisme", "Charging": "Recharge", "Picnic": "Pique-nique", "Wifi": "Wifi",
    },
}
GENERIC_NAME_FR = {
    "drinking water": "Eau potable", "water point": "Point d'eau", "water": "Eau",
    "toilets": "Toilettes", "toilet": "Toilettes", "public toilet": "Toilettes publiques",
    "public toilets": "Toilettes publiques", "restroom": "Toilettes", "restrooms": "Toilettes",
    "wc": "WC", "shower": "Douche", "shelter": "Abri", "picnic": "Pique-nique",
    "picnic site": "Aire de pique-nique", "picnic table": "Table de pique-nique",
    "picnic area": "Aire de pique-nique", "bench": "Banc", "waste basket": "Poubelle",
    "recycling": "Recyclage", "parking": "Parking", "bicycle parking": "Parking vélo",
    "bicycle repair station": "Station de réparation vélo", "camp site": "Camping",
    "hostel": "Auberge", "alpine hut": "Refuge", "chalet": "Chalet", "guest house": "Chambre d'hôtes",
    "motel": "Motel", "hotel": "Hôtel", "supermarket": "Supermarché", "convenience": "Épicerie",
    "bakery": "Boulangerie", "butcher": "Boucherie", "restaurant": "Restaurant", "cafe": "Café",
    "fast food": "Restauration rapide", "bar": "Bar", "pub": "Pub", "pharmacy": "Pharmacie",
    "hospital": "Hôpital", "clinic": "Clinique", "atm": "Distributeur", "bank": "Banque",
    "post office": "Bureau de poste", "post box": "Boîte aux lettres", "viewpoint": "Point de vue",
    "attraction": "Attraction", "museum": "Musée", "castle": "Château", "monument": "Monument",
    "memorial": "Mémorial", "ruins": "Ruines", "information": "Information",
    "charging station": "Borne de recharge", "device charging station": "Station de recharge",
    "library": "Bibliothèque", "internet cafe": "Cybercafé", "laundry": "Laverie",
}

# --- Fixed values: names that say nothing about a place -----------------------
GENERIC_NAMES = [
    "", "unknown", "unnamed",
    "toilets", "toilet", "drinking water", "water", "restroom", "restrooms", "wc",
    "public toilet", "public toilets",
    "shelter", "picnic", "picnic site", "picnic table", "picnic area",
    "bench", "waste basket", "recycling", "parking", "bicycle parking", "bicycle repair station",
    "toilettes", "eau potable", "fontaine", "point d'eau", "abri", "aire de pique-nique", "banc",
    "fuente", "aseos", "servicios",
]

# --- Fixed values: official-site choice ----------------------------------------
OFFICIAL_SITE_TAGS = ["website", "contact:website", "url", "contact:web"]
NOT_OFFICIAL_DOMAINS = [
    "facebook.com", "instagram.com", "twitter.com", "x.com", "google.com", "yelp.com", "yelp.fr",
    "tripadvisor.com", "tripadvisor.fr", "tripadvisor.de", "tripadvisor.es", "tripadvisor.it",
    "tripadvisor.co.uk", "booking.com", "hotels.com", "airbnb.com", "airbnb.fr", "expedia.com",
    "expedia.fr", "foursquare.com", "pagesjaunes.fr", "komoot.com", "linkedin.com", "youtube.com",
    "tiktok.com",
]
NOT_OFFICIAL_BRANDS = ["tripadvisor", "airbnb", "expedia", "yelp", "booking"]

# --- Fixed values: search words -------------------------------------------------
SEARCH_WORDS = {
    "Restaurant or Bar": "avis restaurant horaires", "Food shop": "horaires magasin avis",
    "Sleeping place": "avis hébergement tarif", "Gears": "avis atelier vélo réparation",
}
SEARCH_WORDS_DEFAULT = "avis"

# --- Fixed values: source platforms ----------------------------------------------
# (host part, platform), first hit wins
PLATFORM_BY_HOST = [
    ("google.", "google_maps"), ("yelp.", "yelp"), ("tripadvisor.", "tripadvisor"),
    ("facebook.", "facebook"), ("instagram.", "instagram"), ("booking.", "booking"),
    ("airbnb.", "airbnb"), ("hotels.", "hotels_com"),
]
# platform: (label, display priority)
PLATFORMS = {
    "official_website": ("Official site", 0), "google_maps": ("Google Maps", 1),
    "tripadvisor": ("Tripadvisor", 2), "yelp": ("Yelp", 3), "booking": ("Booking", 4),
    "airbnb": ("Airbnb", 5), "hotels_com": ("Hotels.com", 6), "facebook": ("Facebook", 7),
    "instagram": ("Instagram", 8), "other": ("Web", 9),
}
REPUTATION_PLATFORMS = ["google_maps", "tripadvisor", "yelp", "booking", "airbnb", "hotels_com"]
# (URL pattern, score), first hit wins; no hit scores 1
DOMAIN_QUALITY = [
    (r"tripadvisor\.(com|fr|es|de|co\.uk)", 3), (r"yelp\.(com|fr|es|de|co\.uk)", 3),
    (r"booking\.com", 3), (r"google\.(com|fr|es|de)/maps", 3), (r"maps\.google", 3),
    (r"airbnb\.(com|fr|es)", 3), (r"hotels\.com", 3),
    (r"campingfrance\.com", 2), (r"campingsauvage\.net", 2), (r"refuges\.info", 2),
    (r"komoot\.(com|de|fr)", 2), (r"mairie-|commune-|ville-", 2),
    (r"office-de-tourisme|tourism|tourisme", 2), (r"viamichelin\.(com|fr)", 2),
    (r"lafourchette\.com|thefork\.com", 2), (r"pages-jaunes\.fr|pagesjaunes\.fr", 2),
    (r"cylex\.(fr|com)", 2), (r"restaurantguru\.com", 2), (r"foursquare\.com", 2),
    (r"facebook\.com", 1), (r"instagram\.com", 1),
    (r"twitter\.com|x\.com", 0), (r"linkedin\.com", 0), (r"banking|unicredit|bpce|bnpparibas", 0),
]

# --- Fixed values: first weak-source sentence of each category contract ----------
CONTRACT_WEAK_SOURCE = {
    "Restaurant or Bar": "Limited online presence; verify hours on arrival.",
    "Food shop": "Listed on maps but no online reviews; verify hours and stock on-site.",
    "Sleeping place": "Limited info online — contact directly to confirm availability and price.",
    "Gears": "Listed as a bike/sports shop but limited online info — call ahead for repair availability.",
}

# --- Fixed values: day words -------------------------------------------------------
WEEK = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
_EN = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_EN3 = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
_FR = ["lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"]
_FR3 = ["lun", "mar", "mer", "jeu", "ven", "sam", "dim"]
_ES = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]
_RU = ["понедельник", "вторник", "среда", "четверг", "пятница", "суббота", "воскресенье"]
_RU2 = ["пн", "вт", "ср", "чт", "пт", "сб", "вс"]
_TR = ["pazartesi", "salı", "çarşamba", "perşembe", "cuma", "cumartesi", "pazar"]


def _days(*lists: list[str]) -> dict[str, str]:
    return {word: WEEK[i] for words in lists for i, word in enumerate(words)}


SNIPPET_DAYS = _days(_EN, _FR, _EN3, _FR3)
# Words per map source: days, words that mean closed, words that mean all day,
# separator between hour and minute besides "h" and ":".
MAP_SOURCES = {
    "google": {
        "days": _days(_EN, _EN3, _FR, _ES),
        "block_days": _EN + _FR,
        "closed": ["closed", "fermé", "ferme", "cerrado", "geschlossen", "chiuso", "closed all day"],
        "all_day": r"24\s*hours?|open 24|ouvert 24",
        "all_day_first": False,
        "clock": r"^(\d{1,2})[h:](\d{2})$",
    },
    "yandex": {
        "days": _days(_EN, _EN3, _RU, _RU2, _TR, _FR),
        "block_days": _EN + _RU + _TR + _FR,
        "closed": ["closed", "выходной", "закрыто", "kapalı", "fermé", "ferme", "cerrado"],
        "all_day": r"24\s*hours?|круглосуточно|24\s*saat|24/7|24h",
        "all_day_first": True,
        "clock": r"^(\d{1,2})[h:.](\d{2})$",
    },
}


def rule_rows() -> list[tuple[str, int, bool, str, str, str]]:
    """One row per (category, tag) rule: category, rank, default, key, value, icon."""
    return [
        (name, rank, default, key, value, icon)
        for rank, (name, default, _text, _back, tags) in enumerate(CATEGORIES)
        for key, value, icon in tags
    ]


def rules_table(spark: SparkSession) -> DataFrame:
    """The category dimension (81 rows), including the marker style."""
    style = {name: (text, back) for name, _d, text, back, _t in CATEGORIES}
    rows = [
        (c, r, d, k, v, i, ("circle", "#000000" if style[c][0] == "#000000" else "#FFFFFF", "2", *style[c]))
        for c, r, d, k, v, i in rule_rows()
    ]
    return spark.createDataFrame(
        rows,
        "category string, rank int, default_enabled boolean, key string, value string, icon string, "
        "style struct<iconShape:string,borderColor:string,borderWidth:string,textColor:string,"
        "backgroundColor:string>",
    )


CATEGORY_BY_TAG = {f"{k}={v}": c for c, _r, _d, k, v, _i in rule_rows()}
ICON_BY_TAG = {f"{k}={v}": i for _c, _r, _d, k, v, i in rule_rows()}
BACKGROUND_COLOUR = {name: back for name, _d, _t, back, _tags in CATEGORIES}
DEFAULT_CATEGORIES = [name for name, default, *_ in CATEGORIES if default]
