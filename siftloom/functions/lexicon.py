"""Fixed values of the extraction rules: field names, their tokens and types, word lists and weights."""

from __future__ import annotations

# Canonical fields, their types and the tokens that name them.
FIELD_TOKENS: dict[str, tuple[str, ...]] = {
    "title": ("title", "name", "heading", "headline", "productname", "producttitle", "itemtitle"),
    "description": ("description", "desc", "summary", "excerpt", "snippet", "subtitle", "abstract", "teaser", "caption", "blurb"),
    "price": ("price", "cost", "amount", "pricing", "currentprice", "saleprice", "ourprice", "finalprice", "pricevalue"),
    "old_price": ("oldprice", "wasprice", "listprice", "msrp", "regularprice", "compareatprice", "strikethrough", "originalprice"),
    "currency": ("currency", "pricecurrency", "currencycode"),
    "url": ("url", "link", "permalink", "href", "canonical", "itemurl", "producturl"),
    "image": ("image", "img", "thumb", "thumbnail", "photo", "picture", "cover", "poster", "avatar"),
    "date": ("date", "published", "publishdate", "pubdate", "datetime", "time", "posted", "created", "updated", "datepublished", "timestamp"),
    "author": ("author", "byline", "creator", "writer", "poster", "username", "seller", "vendor"),
    "brand": ("brand", "manufacturer", "make", "publisher"),
    "rating": ("rating", "stars", "score", "ratingvalue", "reviewscore", "averagerating"),
    "reviews": ("reviews", "reviewcount", "ratingcount", "votes", "numreviews", "comments"),
    "category": ("category", "cat", "section", "genre", "department", "topic", "tag", "kind", "type"),
    "sku": ("sku", "mpn", "ean", "upc", "isbn", "gtin", "productcode", "articlenumber", "itemid", "productid", "identifier"),
    "availability": ("availability", "stock", "instock", "stockstatus", "available", "inventory"),
    "location": ("location", "address", "place", "city", "region", "venue", "country", "district"),
    "phone": ("phone", "tel", "telephone", "contactphone"),
    "email": ("email", "mail", "emailaddress"),
    "discount": ("discount", "percentoff", "savings"),
    "duration": ("duration", "length", "runtime", "readtime"),
    "salary": ("salary", "wage", "compensation", "pay", "payrange"),
    "company": ("company", "employer", "organization", "org", "firm"),
    "views": ("views", "viewcount", "plays", "reads"),
}
FIELD_TYPES: dict[str, str] = dict.fromkeys(FIELD_TOKENS, "string") | {
    "price": "number", "old_price": "number", "rating": "number", "discount": "number", "reviews": "integer", "views": "integer", "url": "url", "image": "url", "date": "datetime",
}
SCHEMA_FIELDS: dict[str, str] = {
    "name": "title", "headline": "title", "alternatename": "title", "description": "description", "abstract": "description", "price": "price", "lowprice": "price",
    "pricecurrency": "currency", "url": "url", "mainentityofpage": "url", "image": "image", "thumbnailurl": "image", "contenturl": "image", "datepublished": "date",
    "datecreated": "date", "datemodified": "date", "uploaddate": "date", "startdate": "date", "author": "author", "creator": "author", "brand": "brand", "manufacturer": "brand",
    "ratingvalue": "rating", "reviewcount": "reviews", "ratingcount": "reviews", "category": "category", "genre": "category", "sku": "sku", "mpn": "sku", "gtin13": "sku",
    "productid": "sku", "identifier": "sku", "availability": "availability", "address": "location", "addresslocality": "location", "telephone": "phone", "email": "email",
    "duration": "duration", "timerequired": "duration", "basesalary": "salary", "hiringorganization": "company", "publisher": "brand", "site_name": "brand", "type": "category", "canonical": "url",
}
BOILERPLATE = (
    "read more", "learn more", "see more", "show more", "view all", "details", "add to cart", "buy now", "shop now", "subscribe",
    "sign in", "log in", "next", "previous", "prev", "home", "menu", "search", "close", "share",
)
CURRENCY_SYMBOLS: dict[str, str] = {
    "$": "USD", "US$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₽": "RUB", "₹": "INR", "₩": "KRW", "₴": "UAH", "₺": "TRY",
    "R$": "BRL", "C$": "CAD", "A$": "AUD", "CHF": "CHF", "zł": "PLN", "Kč": "CZK", "kr": "SEK",
}
CURRENCY_CODES = ("AUD", "BRL", "CAD", "CHF", "CNY", "CZK", "DKK", "EUR", "GBP", "INR", "JPY", "KRW", "MXN", "NOK", "PLN", "RUB", "SEK", "TRY", "UAH", "USD")
TRUE_WORDS = ("true", "yes", "y", "1", "in stock", "instock", "available", "on", "enabled")
FALSE_WORDS = ("false", "no", "n", "0", "out of stock", "outofstock", "unavailable", "off", "disabled", "sold out")
#: Provenance in order of rank, with the weight of its base signal.
SOURCES: dict[str, float] = {
    "config": 1.0, "jsonld": 0.55, "microdata": 0.5, "embedded_json": 0.4, "opengraph": 0.45, "table": 0.4, "semantic": 0.3, "dom": 0.25,
    "attribute": 0.3, "classname": 0.32, "pattern": 0.28, "position": 0.12,
}
SKIP_TAGS = ("script", "style", "noscript", "template", "svg", "path", "head", "meta", "link", "br", "hr")
STRONG_TAGS = ("article", "li", "tr")
WEAK_TAGS = ("span", "b", "i", "em", "strong", "br", "label", "option", "th", "td")
RECORD_WORDS = (
    "item", "items", "card", "cards", "product", "products", "listing", "listings", "entry", "entries", "result", "results", "post", "posts",
    "tile", "tiles", "cell", "teaser", "article", "job", "offer", "ad", "grid-item",
)
NAV_WORDS = ("nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "header", "sidebar", "social", "tabs")
NEXT_TEXT = (
    "next", "next page", "next »", "older", "older posts", "older entries", "weiter", "nächste", "nächste seite", "suivant", "suivante", "page suivante", "siguiente", "próxima",
    "proxima", "seguinte", "avanti", "successiva", "volgende", "næste", "nästa", "seuraava", "następna", "další", "далее", "следующая", "вперёд", "вперед", "keyingi",
    "次へ", "次のページ", "下一页", "下一頁", "다음",
)
NEXT_GLYPHS = ("›", "»", "→", ">", ">>", "▶", "❯", "⟩")
PREV_TEXT = ("prev", "previous", "back", "zurück", "précédent", "anterior", "назад", "предыдущая")
PAGE_PARAMS = ("page", "p", "pg", "pagina", "seite", "offset", "start", "from", "skip")
STEP_PARAMS = ("offset", "start", "from", "skip")
BLOCK_MARKERS = (
    r"\bcf-browser-verification\b", r"\bcf-challenge\b", r"Checking your browser before accessing", r"Just a moment\.\.\.", r"\bg-recaptcha\b", r"\bh-captcha\b", r"data-sitekey=",
    r"Access denied.{0,60}(Cloudflare|Akamai|Incapsula)", r"Request unsuccessful\. Incapsula", r"\bpx-captcha\b", r"Please verify you are a human", r"unusual traffic from your computer network",
)
BLOCK_STATUS = (401, 403, 429, 503)
# End of fixed values.

TOKEN_FIELD = {t: f for f, tokens in FIELD_TOKENS.items() for t in tokens}
SCHEMA_FIELD = TOKEN_FIELD | SCHEMA_FIELDS
