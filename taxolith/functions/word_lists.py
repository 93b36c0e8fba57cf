"""Default word lists and the ordered cleaning patterns that are built from lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from taxolith.functions.text import quoted

# The default lists, in their files' order.
COLORS = [
    "Forest Green", "Royal Blue", "Navy Blue", "Turquoise", "Sky Blue", "Orange", "Purple", "Silver", "Violet", "Yellow", "Amber", "Beige", "Black",
    "Brown", "Clear", "Green", "Olive", "Pearl", "White", "Blue", "Gold", "Gray", "Grey", "Lime", "Navy", "Pink", "Red", "Tan",
]
COLOR_ABBREVS = [
    "FST GRN", "NBLU", "RBLU", "SBLU", "AMB", "BEI", "BLK", "BLU", "BRN", "CLR", "GLD", "GRN", "GRY", "OLV", "ORG", "PNK", "PRL", "PUR", "RED", "SLV",
    "TAN", "TRQ", "VLT", "WHT", "YLW", "BK", "BL", "CH", "GY", "LM", "NV", "OG", "OR", "RD", "SV", "WH", "YW",
]
SIZES = [
    "MEDIUMLARGE", "SMALL", "MEDIUM", "LARGE", "EXTRALARGE", "EXTRA LARGE", "XXS", "XS", "S", "ST", "SM", "M", "MED", "MD", "MT", "L", "LRG", "LG",
    "LT", "X", "XL", "XLT", "XLRG", "XXL", "2XL", "2X", "2XLT", "XXXL", "3X", "3XL", "3XLT", "XXXXL", "4X", "4XL", "4XLT", "XXXXXL", "5X", "5XL",
    "5XLT", "28L", "29L", "30L", "31L", "32L", "33L", "34L", "35L", "36L", "37L", "38L", "39L", "40L", "41L", "42L", "43L", "44L", "45L", "46L",
    "47L", "48L", "49L", "50L", "51L", "52L", "53L", "54L", "55L", "56L", "57L", "58L", "X28", "X29", "X30", "X31", "X32", "X33", "X34", "X35", "X36",
    "X37", "X38", "X39", "X40", "X41", "X42", "X43", "X44", "X45", "X46", "X47", "X48", "X49", "X50", "X51", "X52", "X53", "X54", "X55", "X56", "X57",
]
UNIT_ABBREVS = [
    "CU FT", "CU IN", "CU YD", "FTFT", "ININ", "GAL", "MIL", "TPI", "BG", "BX", "CA", "CM", "EA", "FT", "GR", "ID", "IN", "KG", "LB", "ML", "MM",
    "OD", "OZ", "PK", "PT", "QT", "YD", "G", "L", "M", "T",
]
UNIT_PLURALS = [
    "Cubic Inches", "Centimeters", "Centimetres", "Cubic Yards", "Cubic Feet", "Mililiters", "Mililitres", "Milimeters", "Milimetres", "Kilograms",
    "Gallons", "Inches", "Liters", "Litres", "Meters", "Metres", "Ounces", "Pounds", "Quarts", "Spools", "Grams", "Pints", "Yards", "Feet",
]
UNITS = [
    "Inner Diameter", "Outer Diameter", "Centimeter", "Centimetre", "Cubic Foot", "Cubic Inch", "Cubic Yard", "Mililiter", "Mililitre", "Milimeter",
    "Milimetre", "Kilogram", "Gallon", "Liter", "Litre", "Meter", "Metre", "Ounce", "Pound", "Quart", "Spool", "Foot", "Gram", "Inch", "Pint", "Yard",
]
DEFAULT = {
    "colors": [c.upper() for c in COLORS], "color_abbrevs": COLOR_ABBREVS, "sizes": SIZES,
    "unit_abbrevs": UNIT_ABBREVS, "unit_plurals": [u.upper() for u in UNIT_PLURALS], "units": [u.upper() for u in UNITS],
}


def patterns(lists: Mapping[str, Sequence[str]] = DEFAULT) -> tuple[list[str], dict[str, str], list[str], dict[str, str]]:
    """Deletions, replacements, deletions, replacements: to be applied in this order.

    List terms are patterns themselves, except sizes after SZ. The look-behind for white space means that a text's
    first token is left alone by the rules on colours, units and sizes."""
    colour, abbreviation, size, unit = ("|".join(lists[k]) for k in ("colors", "color_abbrevs", "sizes", "unit_abbrevs"))
    literal_size = "|".join(map(quoted, lists["sizes"]))
    # The rules, in order.
    packs_and_fractions = [
        r"\(DV\)|\[DV\]|\(DC\)|\[DC\]",
        r"(?<=\s)\d+/(CT|CNT|CA|PK|BX|BG|CASE|PACK|BOX|BAG|RL|ROLL)",
        r"(?<=\s)\d+(?:-)?/(CNT|CT)/(CA|PK|BX|BG|RL|ROLL)",
        r"[.]",
        r"(?:\d+-)?\d+/\d+[Xx]\d+",
        r"\d+/\d+[Xx]\d+-\d+/\d+",
        r"\d+[Xx]\d+-\d+/\d+",
        r"\d+/\d+[Xx]\d+",
        r"\d+-\d+/\d+",
        r"\d+/\d+",
    ]
    sizes_units_and_signs = [
        rf"(?<=\s)\d+(?:(?:X\d+)|({unit}))*({unit})(?=\s|$)",
        rf"(?<=\s)\d+({unit})(?=\s|$)",
        rf"(?<=\s)({abbreviation})(?=\s|$)",
        rf"(?<=\s)({colour})(?=\s|$)",
        rf"(?:^|\s)({size})/({size})(?=\s|$)",
        rf"(?<=\s)({size})(?=\s|$)",
        r"(?<=\s)\d+(CT|CNT|CA|PK|BX|BG)(?=\s|$)",
        r"W/",
        r"(?i)(?<=\s)(?:(?:\d+(?:\.\d+)?|X|/|-)){2,}(?=\s|$)",
        r"\d+-\d+/\d+\s*X\s*\d+-\d+/\d+",
        r"\b\d+-\d+/\d+",
        r"[\./()<>#&+\"!@$%^\*]",
        r"\d+X\d+",
        r"(?<=\s)\d+(?=\s|$)",
        r"(?<=\s)(?=\S*[X\-/.])(?:[X\-/.]|FT|IN|CM|MM|MIL|TPI|TP|T)+(?=\s|$)",
        r"(?<=\s)X(?=\s|$)",
        rf"SZ(?=\s|$)|SZ\d\S*|\d+SZ\S*|SZ[./\-:;]\S*|SZ(?:{literal_size})\b",
    ]
    return packs_and_fractions, {"[']": " "}, sizes_units_and_signs, {r"\s{2,}": " "}
