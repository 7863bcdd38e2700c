"""Fixed values that results must agree on: word lists, outlet lists, lookup tables."""

# --- keyword synonyms (fixed values) -------------------------------------
SYNONYMS = {
    "marine energy": [
        "wave energy", "wave power", "tidal energy", "tidal power", "ocean energy",
        "ocean power", "hydrokinetic", "wave energy converter",
    ],
    "wave energy": ["wave power", "ocean power", "marine energy", "ocean energy", "tidal energy"],
    "wave power": ["wave energy", "marine energy", "ocean energy", "tidal power"],
    "tidal energy": ["tidal power", "marine energy", "ocean energy", "tidal stream", "tidal current"],
    "ocean energy": ["wave energy", "wave power", "tidal energy", "marine energy", "hydrokinetic"],
}

# --- terms too short or ambiguous to match (fixed values) ----------------
BLOCKED_SHORT_TERMS = ["wec", "ev", "ai", "llm", "ccs", "ccus"]

# --- broad terms for high-priority sources (fixed values) ----------------
BROAD_TERMS = [
    "renewable", "clean energy", "offshore", "ocean", "maritime", "marine", "tidal", "wave power",
    "corpower", "minesto", "orbital marine", "energy transition", "net zero", "decarboni",
    "floating wind", "seabed", "hydrokinetic", "blue energy",
]

# --- major outlets (fixed values) ----------------------------------------
MAJOR_OUTLETS = [
    "reuters.com", "apnews.com", "bloomberg.com", "afp.com",
    "nytimes.com", "washingtonpost.com", "wsj.com", "ft.com",
    "cnbc.com", "cnn.com", "nbcnews.com", "abcnews.go.com",
    "cbsnews.com", "npr.org", "politico.com", "theatlantic.com",
    "time.com", "forbes.com", "usatoday.com", "latimes.com", "businessinsider.com",
    "theguardian.com", "bbc.com", "bbc.co.uk", "thetimes.co.uk",
    "telegraph.co.uk", "independent.co.uk", "sky.com", "standard.co.uk",
    "heraldscotland.com", "scotsman.com", "pressandjournal.co.uk",
    "euronews.com", "euractiv.com", "politico.eu",
    "spiegel.de", "faz.net", "sueddeutsche.de", "dw.com", "handelsblatt.com",
    "lemonde.fr", "lefigaro.fr", "lecho.be", "elpais.com", "corriere.it", "repubblica.it",
    "dn.se", "svd.se", "di.se", "aftonbladet.se", "expressen.se",
    "aftenposten.no", "dn.no", "vg.no", "nrk.no", "e24.no",
    "berlingske.dk", "politiken.dk", "borsen.dk", "dr.dk", "yle.fi", "hs.fi",
    "abc.net.au", "smh.com.au", "theage.com.au", "afr.com",
    "theaustralian.com.au", "news.com.au", "sbs.com.au",
    "nzherald.co.nz", "stuff.co.nz", "rnz.co.nz", "newsroom.co.nz",
    "carbonbrief.org", "energymonitor.ai",
]

# --- curated priority lists of the registry (fixed values) ---------------
PRIORITY_MAJOR = [
    "reuters.com", "apnews.com", "bloomberg.com", "afp.com",
    "nytimes.com", "washingtonpost.com", "wsj.com", "ft.com",
    "cnbc.com", "cnn.com", "nbcnews.com", "cbsnews.com", "npr.org",
    "theguardian.com", "bbc.com", "bbc.co.uk", "thetimes.co.uk",
    "telegraph.co.uk", "independent.co.uk", "sky.com",
    "euronews.com", "euractiv.com", "politico.eu", "politico.com",
    "spiegel.de", "faz.net", "sueddeutsche.de", "dw.com", "lemonde.fr", "lefigaro.fr",
    "dn.se", "svd.se", "di.se", "aftonbladet.se", "expressen.se",
    "aftenposten.no", "dn.no", "vg.no", "nrk.no", "e24.no",
    "berlingske.dk", "politiken.dk", "borsen.dk", "dr.dk", "yle.fi", "hs.fi",
    "abc.net.au", "smh.com.au", "theage.com.au", "afr.com",
    "theaustralian.com.au", "news.com.au", "sbs.com.au",
    "nzherald.co.nz", "stuff.co.nz", "rnz.co.nz", "carbonbrief.org", "energymonitor.ai",
]
PRIORITY_INDUSTRY = [
    "renews.biz", "offshore-energy.biz", "rechargenews.com",
    "oceanenergy-europe.eu", "emec.org.uk", "about.bnef.com",
]

# --- publisher name to domain (fixed values) -----------------------------
PUBLISHER_DOMAINS = {
    "reuters": "reuters.com", "bbc": "bbc.co.uk", "bbc news": "bbc.co.uk",
    "the guardian": "theguardian.com", "the new york times": "nytimes.com",
    "bloomberg": "bloomberg.com", "financial times": "ft.com", "ft": "ft.com",
    "cnbc": "cnbc.com", "cnn": "cnn.com", "forbes": "forbes.com",
    "the washington post": "washingtonpost.com", "wsj": "wsj.com",
    "the wall street journal": "wsj.com", "associated press": "apnews.com", "ap": "apnews.com",
    "euronews": "euronews.com", "euractiv": "euractiv.com", "politico": "politico.eu",
    "the economist": "economist.com", "npr": "npr.org",
    "the telegraph": "telegraph.co.uk", "the independent": "independent.co.uk",
    "the times": "thetimes.co.uk", "the scotsman": "scotsman.com",
    "the herald": "heraldscotland.com", "the press and journal": "pressandjournal.co.uk",
    "sky news": "sky.com", "dw": "dw.com", "france 24": "france24.com",
    "spiegel": "spiegel.de", "der spiegel": "spiegel.de", "le monde": "lemonde.fr",
    "el país": "elpais.com", "carbon brief": "carbonbrief.org",
    "dn": "dn.se", "svd": "svd.se", "aftenposten": "aftenposten.no", "nrk": "nrk.no",
    "techcrunch": "techcrunch.com", "the verge": "theverge.com", "ars technica": "arstechnica.com",
    "axios": "axios.com", "pbs": "pbs.org", "nfl.com": "nfl.com",
    "abc news": "abcnews.go.com", "cbs news": "cbsnews.com", "nbc news": "nbcnews.com",
    "renewables now": "renewablesnow.com", "recharge": "rechargenews.com",
    "offshore energy": "offshore-energy.biz", "windpower monthly": "windpowermonthly.com",
}

# --- publisher fixes of aggregator rows, with major flag (fixed values) --
AGGREGATOR_FIXES = [
    ("Offshore-Energy.biz", "offshore-energy.biz", False),
    ("reNEWS", "renews.biz", False),
    ("reNews", "renews.biz", False),
    ("Nature", "nature.com", True),
    ("BBC", "bbc.co.uk", True),
    ("BBC News", "bbc.co.uk", True),
    ("The Guardian", "theguardian.com", True),
    ("Reuters", "reuters.com", True),
    ("Euronews", "euronews.com", True),
    ("Herald Scotland", "heraldscotland.com", True),
    ("HeraldScotland", "heraldscotland.com", True),
    ("The Scotsman", "scotsman.com", True),
    ("Forbes", "forbes.com", True),
    ("CNBC", "cnbc.com", True),
]

# --- allowed languages (fixed values) ------------------------------------
ALLOWED_LANGUAGES = [
    "en", "de", "fr", "es", "it", "pt", "nl", "da", "sv", "no", "nb", "nn", "fi",
    "pl", "cs", "hu", "ro", "bg", "hr", "sk", "sl", "et", "lv", "lt", "el", "ga",
    "ca", "eu", "gl", "is", "mt", "lb", "cy",
]

# --- blocked hosts and paths (fixed values) ------------------------------
BLOCKED_HOSTS_SEARCH = [
    "facebook.com", "m.facebook.com", "l.facebook.com",
    "twitter.com", "x.com", "mobile.twitter.com", "instagram.com", "linkedin.com",
    "youtube.com", "m.youtube.com", "youtu.be", "tiktok.com", "reddit.com", "old.reddit.com",
    "pinterest.com", "tumblr.com", "snapchat.com", "threads.net", "mastodon.social", "bsky.app",
    "t.me", "telegram.org", "wa.me", "whatsapp.com", "discord.com", "discord.gg",
]
BLOCKED_HOSTS_MAIN = BLOCKED_HOSTS_SEARCH + ["news.google.com", "google.com"]
BLOCKED_HOSTS_MODEL = [
    "facebook.com", "m.facebook.com", "l.facebook.com",
    "twitter.com", "x.com", "mobile.twitter.com", "instagram.com", "linkedin.com",
    "youtube.com", "m.youtube.com", "youtu.be", "tiktok.com", "reddit.com", "old.reddit.com",
    "pinterest.com", "tumblr.com", "snapchat.com", "threads.net", "mastodon.social", "bsky.app",
]
BLOCKED_HOSTS_BACKFILL = [
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com",
    "youtube.com", "reddit.com", "tiktok.com", "pinterest.com",
]
BLOCKED_PATHS = [
    "/posts?/", "/video/", "/watch/", "/reel", "/status/", "/stories/", "/shorts/", "/live/", "/pin/",
]
BLOCKED_PATHS_MODEL = ["/posts?/", "/video/", "/watch/", "/status/"]

# --- tracking parameters stripped from canonical URLs (fixed values) -----
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "oc", "ref", "fbclid", "gclid",
]

# --- subscription sites (fixed values) -----------------------------------
PAYWALLED_DOMAINS = [
    "wsj.com", "ft.com", "bloomberg.com", "economist.com", "barrons.com", "telegraph.co.uk",
    "thetimes.co.uk", "thetimes.com", "washingtonpost.com", "bostonglobe.com", "hbr.org",
    "newyorker.com", "theatlantic.com", "lloydslist.com", "upstreamonline.com",
    "tradewindsnews.com", "montelnews.com", "woodmac.com", "rystadenergy.com",
    "seekingalpha.com", "spglobal.com",
]

# --- tracked entities and their mention terms (fixed values) -------------
ENTITIES = {
    "CorPower Ocean": ["corpower", "corpowerocean", "corpower ocean"],
    "Minesto": ["minesto"],
    "Orbital Marine": ["orbital marine", "orbital power"],
    "Eco Wave Power": ["eco wave power", "ecowavepower"],
    "Mocean Energy": ["mocean energy", "mocean"],
    "Carnegie": ["carnegie clean energy", "carnegie wave"],
}

# --- off-topic purge phrases (fixed values) ------------------------------
ON_TOPIC_PHRASES = [
    "wave energy", "wave power", "tidal", "ocean energy", "ocean power", "marine energy", "corpower",
    "hydrokinetic", "wave energy converter", "eco wave", "ocean thermal", "osmotic power",
]
OFF_TOPIC_PHRASES = [
    "offshore wind", "wind farm", "wind turbine", "windpower", "solar", "onshore wind",
    "floating wind", "gas network", "coal closure", "battery boom", "rooftop solar",
    "copper project", "kazakh wind", "steps down", "hvdc", "wind supply chain",
]

# --- themes looked up in owned blog posts (fixed values) -----------------
BLOG_THEMES = [
    "wave energy", "ocean energy", "marine energy", "C4", "HiWave-5", "partnership", "funding",
    "milestone", "testing", "deployment", "Portugal", "Sweden",
]

# --- metric words that identify the header row of an export (fixed values)
METRIC_HEADERS = [
    "date", "impressions", "clicks", "likes", "comments", "shares", "reposts", "engagement",
    "reactions", "followers",
]

# --- map coordinates, (longitude, latitude) by country (fixed values) ----
COUNTRY_COORDS = {
    "US": (-95, 38), "GB": (-1, 53), "DE": (10, 51), "FR": (2, 47), "QA": (51, 25),
    "SE": (18, 62), "JP": (139, 36), "AU": (134, -25), "BR": (-51, -10), "IN": (78, 22),
    "CN": (104, 35), "ZA": (25, -29), "NG": (8, 10), "EG": (30, 27), "KR": (127, 36),
    "CA": (-106, 56), "MX": (-102, 23), "AR": (-64, -34), "RU": (100, 60), "IT": (12, 42),
    "NZ": (174, -41), "PT": (-8, 39), "ES": (-4, 40), "NL": (5, 52), "BE": (4, 51),
    "CH": (8, 47), "AT": (14, 47), "NO": (10, 62), "DK": (10, 56), "FI": (26, 64),
    "IE": (-8, 53), "SG": (104, 1), "PL": (20, 52), "CZ": (15, 50), "GR": (22, 39),
}

# --- outlets of the coverage audit: domain, name, region (fixed values) --
AUDIT_OUTLETS = [
    ("bbc.com", "BBC News", "UK"),
    ("theguardian.com", "The Guardian", "UK"),
    ("ft.com", "Financial Times", "UK"),
    ("telegraph.co.uk", "The Telegraph", "UK"),
    ("independent.co.uk", "The Independent", "UK"),
    ("theherald.co.uk", "The Herald", "UK"),
    ("heraldscotland.com", "Herald Scotland", "UK"),
    ("scotsman.com", "The Scotsman", "UK"),
    ("irishtimes.com", "The Irish Times", "IE"),
    ("rte.ie", "RTÉ News", "IE"),
    ("euronews.com", "Euronews", "EU"),
    ("reuters.com", "Reuters", "EU"),
    ("politico.eu", "Politico Europe", "EU"),
    ("euractiv.com", "EurActiv", "EU"),
    ("dw.com", "Deutsche Welle (EN)", "EU"),
    ("france24.com", "France 24 (EN)", "EU"),
    ("thelocal.com", "The Local", "EU"),
    ("nytimes.com", "New York Times", "US"),
    ("washingtonpost.com", "Washington Post", "US"),
    ("apnews.com", "AP News", "US"),
    ("cnn.com", "CNN", "US"),
    ("bloomberg.com", "Bloomberg", "US"),
    ("wsj.com", "Wall Street Journal", "US"),
    ("npr.org", "NPR", "US"),
    ("japantimes.co.jp", "Japan Times", "JP"),
    ("asia.nikkei.com", "Nikkei Asia", "JP"),
    ("abc.net.au", "ABC News AU", "AU"),
    ("smh.com.au", "Sydney Morning Herald", "AU"),
    ("theaustralian.com.au", "The Australian", "AU"),
    ("nzherald.co.nz", "NZ Herald", "NZ"),
    ("stuff.co.nz", "Stuff NZ", "NZ"),
    ("rnz.co.nz", "RNZ", "NZ"),
]

# --- month names accepted in URL paths (fixed values) --------------------
URL_MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7,
    "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9,
    "oct": 10, "nov": 11, "dec": 12,
}

# --- order in which connectors arrive (fixed values) ---------------------
CONNECTOR_ORDER = ["rss", "perigon", "guardian", "gdelt", "newsapi"]
