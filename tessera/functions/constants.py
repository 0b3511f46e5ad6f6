"""Fixed values that results depend on: patterns, cues, word lists and palettes."""

from __future__ import annotations

# Fixed values of the query router.
COMPANION_PATTERNS = (
    r"\b(?:pair|wear|style|match|combine)(?:s|ed|ing)?(?:\s+(?:it|this|that|these|them|one|ones))?\s+with\b",
    r"\bgo(?:es|ing)?\s+(?:well\s+)?with\b",
    r"\bworn\s+with\b",
    r"\b(?:along|together)\s+with\b",
)
PROPERTY_PATTERNS = (r"\bwhat brand\b", r"\bwhich brand\b", r"\bwhose brand\b", r"\bwho makes?\b", r"\bwho made\b", r"\bwhat make\b", r"\bwhat label\b", r"\bbrand (?:is|are|of)\b")
EXACTNESS_CUES = ("this exact", "the exact", "exactly this", "exact same", "this specific", "this particular", "exact product", "exact model", "exact one")
SIMILARITY_CUES = ("like this", "similar to this", "similar to these", "something like", "looks like", "in the style of", "same vibe")

# Colour words in the order in which they are tried.
COLOUR_RULES = (
    ("off white", "cream"), ("off-white", "cream"), ("cream", "cream"), ("ivory", "cream"), ("bone", "cream"), ("summit white", "cream"), ("cloud white", "cream"), ("core white", "cream"), ("pearl", "cream"), ("white", "cream"), ("gum", "gum"), ("obsidian", "navy"), ("navy", "navy"), ("indigo", "navy"),
    ("black", "black"), ("jet black", "black"), ("onyx", "black"), ("charcoal", "gray"), ("grey", "gray"), ("gray", "gray"), ("smoke", "gray"), ("stone", "tan"), ("concrete", "gray"), ("cement", "gray"), ("silver", "gray"), ("platinum", "gray"), ("chrome", "gray"),
    ("metallic gold", "gold"), ("gold", "gold"), ("khaki", "khaki"), ("beige", "tan"), ("tan", "tan"), ("camel", "tan"), ("sand", "tan"), ("teal", "teal"), ("turquoise", "teal"), ("aqua", "teal"), ("blue", "blue"), ("denim", "blue"), ("cobalt", "blue"), ("sapphire", "blue"),
    ("maroon", "maroon"), ("burgundy", "maroon"), ("wine", "maroon"), ("red", "red"), ("crimson", "red"), ("scarlet", "red"), ("ruby", "red"), ("coral", "pink"), ("fuchsia", "pink"), ("magenta", "pink"), ("blush", "pink"), ("pink", "pink"), ("rose", "pink"),
    ("purple", "purple"), ("violet", "purple"), ("lavender", "purple"), ("grape", "purple"), ("plum", "purple"), ("mauve", "purple"), ("lilac", "purple"), ("amethyst", "purple"), ("orchid", "purple"), ("olive", "olive"), ("sage", "olive"), ("moss", "olive"),
    ("green", "green"), ("mint", "green"), ("forest", "green"), ("emerald", "green"), ("brown", "brown"), ("chocolate", "brown"), ("cocoa", "brown"), ("espresso", "brown"), ("mocha", "brown"), ("walnut", "brown"), ("mahogany", "brown"), ("chestnut", "brown"),
    ("coffee", "brown"), ("tobacco", "brown"), ("umber", "brown"), ("orange", "orange"), ("tangerine", "orange"), ("citron", "yellow"), ("yellow", "yellow"), ("maize", "yellow"), ("multi", "multi"), ("camo", "multi"), ("rainbow", "multi"),
)

# Names of shades that the words above don't tell, or not rightly.
EXACT_COLOURS = {
    "sail": "cream", "phantom": "cream", "coconut milk": "cream", "natural": "cream", "photon dust": "gray", "mineral slate": "gray", "pearl grey": "gray", "carbon heather": "gray", "carbon": "gray", "anthracite": "gray", "gridiron": "gray", "magnet": "gray",
    "timberwolf": "gray", "ghost": "gray", "steam": "gray", "night sky": "navy", "old royal": "navy", "off noir": "black", "nightshade": "black", "amarillo": "yellow", "collegiate royal": "blue", "game royal": "blue", "royal": "blue", "hyper royal": "blue",
    "team carolina": "blue", "iced carmine": "red", "malachite": "green", "dusty cactus": "olive", "cucumber calm": "green", "spruce aura": "green", "spruce fog": "green", "black spruce": "green", "arctic night": "green", "silver moss": "green",
    "pink smoke": "pink", "sandy pink": "pink", "pearl pink": "pink", "peony": "pink", "stone pink": "pink", "smoked violet": "purple", "platinum violet": "purple", "dark concord": "purple", "dark raisin": "purple", "aurora ivy": "green", "mosswood brown": "brown",
    "earth strata": "tan", "desert": "tan", "desert berry": "pink", "stone khaki": "khaki", "light orewood brown": "tan", "hemp": "tan", "malt": "tan", "pumpernickel": "brown", "cortado": "brown", "cacao wow": "brown", "sequoia": "brown", "clay": "tan", "warm clay": "tan",
    "mushroom": "tan", "taupe haze": "tan", "dark taupe": "tan", "dark driftwood": "brown", "dark stucco": "tan", "turtle dove": "tan", "turtledove": "tan", "doll": "tan", "lucid tangerine": "orange", "tangerine heat": "orange", "hot lava": "orange",
    "infrared 23": "orange", "neo flame": "red", "aluminum": "gray", "alumina": "gray", "metallic copper": "brown", "copper metallic": "brown", "metallic red bronze": "maroon", "wonder quartz": "tan", "moonbeam": "cream", "lightning": "gray", "shimmer": "gray",
    "reflection": "gray", "raincloud": "gray", "rain cloud": "gray", "castlerock": "gray", "heather": "gray", "slate": "gray", "ashen slate": "gray", "mineral": "gray", "aura": "gray", "afterglow": "orange", "sweet beet": "maroon", "mystic dates": "brown",
    "hydrangeas": "purple", "periwinkle": "blue", "lapis": "blue", "chalk": "cream", "crystal linen": "cream", "alabaster": "cream", "sea salt": "cream", "linen": "cream", "angora": "cream", "clear sky": "blue", "crystal sky": "blue", "tattoo": "red",
    "ironstone": "gray", "volt ice": "yellow", "light liquid lime": "yellow", "lime blast": "yellow", "taupe": "tan", "breakfast tea": "brown", "pencil point": "gray", "truffle salt": "brown",
}

# Facet rules in the order in which they are tried.
FACET_RULES = {
    "material": (
        (r"suede|nubuck", "suede"), (r"leather", "leather"), (r"denim", "denim"), (r"corduroy", "corduroy"), (r"fleece|terry|pile|sherpa", "fleece"), (r"mesh", "mesh"), (r"canvas|duck", "canvas"), (r"twill|ripstop|poplin|oxford|flannel|chambray", "twill"), (r"linen", "linen"),
        (r"wool|acrylic|boucle|cashmere", "wool"), (r"nylon|polyamide|supplex|gore tex", "nylon"), (r"poly", "polyester"), (r"knit|jersey", "knit"), (r"cotton", "cotton"), (r"vegan|synthetic|textile|fabric|tpu|flex|rubber|quilt", "synthetic"),
    ),
    "fit": ((r"crop", "cropped"), (r"relax|roomy|generous|easy|spacious", "relaxed"), (r"loose|baggy|oversized|boxy|wide|big|tall|larger", "loose"), (r"slim|skinny|snug|tight|fitted|streamlined|athletic|taper", "slim"), (r"straight|bootcut|flare", "straight"), (r"adjust|customiz|elastic|cinch", "adjustable"), (r"regular|standard|classic|true to size|modern|timeless|versatile", "regular")),
    "closure": (
        (r"snapback|strapback", "strapback"), (r"button fly|fly.*button|button.*fly", "button fly"), (r"fly", "zip fly"), (r"lace", "lace-up"), (r"zip", "zip"), (r"snap", "snap"), (r"button|placket", "button"), (r"crew|v neck|pullover|hood", "pullover"),
        (r"drawcord|drawstring|bungee|elastic", "drawstring"), (r"buckle|hook|velcro|adjust|strap", "adjustable strap"), (r"none|no closure|slip on", "none"),
    ),
    "length": ((r"crop|cutoff|3 4|7 8|above the knee|mid thigh|short", "cropped"), (r"knee", "knee length"), (r"full|long|maxi", "full length")),
}
# Fixed value: a length in inches.
INCHES = r"(\d+(?:\.\d+)?)\s*(?:inch|in\b|inseam)"

# Swatches, as sRGB.
PALETTE = {
    "black": (25, 25, 27), "charcoal": (65, 65, 68), "gray": (128, 128, 130), "light gray": (190, 190, 192), "white": (240, 240, 240), "cream": (238, 226, 200), "beige": (214, 196, 166), "brown": (110, 78, 52), "tan": (170, 132, 88), "olive": (110, 112, 62),
    "green": (60, 130, 70), "navy": (36, 46, 82), "blue": (60, 100, 180), "light blue": (145, 180, 220), "purple": (110, 70, 150), "red": (170, 45, 45), "pink": (225, 150, 165), "orange": (215, 125, 50), "yellow": (225, 200, 70),
}

# Where a text of several garments is cut, and words that name a group or a category of garments.
CLAUSE_SPLIT = r"\b(?:with|and|plus|over|under|paired with|worn with)\b|[,+&/]"
GROUP_WORDS = {
    "shoe": "footwear", "shoes": "footwear", "sneaker": "footwear", "sneakers": "footwear", "trainers": "footwear", "kicks": "footwear", "boot": "footwear", "boots": "footwear", "loafer": "footwear", "loafers": "footwear", "sandal": "footwear", "sandals": "footwear",
    "top": "tops", "tops": "tops", "shirt": "tops", "shirts": "tops", "tee": "tops", "tees": "tops", "t-shirt": "tops", "sweater": "tops", "hoodie": "tops", "sweatshirt": "tops", "jumper": "tops",
    "pants": "bottoms", "trousers": "bottoms", "jeans": "bottoms", "denim": "bottoms", "shorts": "bottoms", "bottoms": "bottoms", "joggers": "bottoms", "sweatpants": "bottoms", "chinos": "bottoms",
    "jacket": "outerwear", "coat": "outerwear", "outerwear": "outerwear", "puffer": "outerwear", "parka": "outerwear", "windbreaker": "outerwear",
    "hat": "accessories", "cap": "accessories", "beanie": "accessories", "bag": "accessories", "belt": "accessories", "socks": "accessories",
}
CATEGORY_WORDS = {
    "sweater": "sweater", "jumper": "sweater", "knit": "sweater", "cardigan": "sweater", "hoodie": "hoodie", "hooded": "hoodie", "sweatshirt": "sweatshirt", "crewneck": "sweatshirt", "t-shirt": "t-shirt", "tshirt": "t-shirt", "tee": "t-shirt",
    "shirt": "shirt", "button-up": "shirt", "button-down": "shirt", "oxford": "shirt", "flannel": "shirt", "tank": "tank top", "tank top": "tank top", "vest": "tank top", "jacket": "jacket", "coat": "jacket", "puffer": "jacket", "parka": "jacket", "windbreaker": "jacket", "bomber": "jacket",
    "pants": "pants", "trousers": "pants", "jeans": "pants", "chinos": "pants", "joggers": "pants", "sweatpants": "pants", "shorts": "shorts", "jorts": "shorts", "sneaker": "sneaker", "sneakers": "sneaker", "trainers": "sneaker", "kicks": "sneaker",
    "loafer": "loafer", "loafers": "loafer", "hat": "hat", "cap": "hat", "beanie": "hat", "socks": "socks", "sock": "socks",
}
# Words of a query that name no attribute.
STOPWORDS = ("a", "an", "the", "with", "and", "in", "for", "of", "on", "some", "this", "that", "these", "those", "wearing", "worn", "plus", "also")
