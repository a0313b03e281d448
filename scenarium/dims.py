"""Labels, families, weights and word forms that results depend on, and their columns.

Each table is plain text, one group a line, in the order in which the first match wins. Large tables of a deployment
(scene classes, detector vocabularies, stop words) are parameters of the operators, not part of the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _groups(text: str) -> dict[str, list[str]]:
    pairs = (line.split(":", 1) for line in text.strip().splitlines())
    return {name.strip(): [w.strip() for w in words.split(",") if w.strip()] for name, words in pairs}


#: Category of a label; every other label is an object.
CATEGORIES = _groups("""
human: person, man, woman, child, crowd, vendor, audience
animal: horse, donkey, cow, sheep, goat, dog, cat, bird, zebra, lion, tiger, giraffe
vehicle: car, bus, truck, bicycle, motorcycle, cart, wagon, wooden cart, boat, ship, train, tram, tractor, wheelchair, forklift
structure: building, house, church, cathedral, temple, tower, bell tower, wall, stone wall, fence, gate, door, window, bridge, barn, stable, corral, animal pen, monument, statue, arch, column, altar, grave, boathouse, dock, pier, gazebo, lifeguard tower
vegetation: tree, plant, grass, flower, crop, field crop, bush, forest
tool: tool, farm tool, plow, instrument, microphone, speaker, machine, engine, pipe, crane, medical equipment, equipment
food: food, bread, fruit, vegetable, vegetables, grain, hay
""")
DEFAULT_CATEGORY = "object"
#: The categories a record may give itself.
VALID_CATEGORIES = ["human", "animal", "vehicle", "structure", "vegetation", "tool", "food", "object", "other"]
#: Weight of a category in an entity's importance.
CATEGORY_WEIGHTS = {"human": 1.0, "animal": 0.95, "vehicle": 0.85, "tool": 0.75, "food": 0.7, "structure": 0.6, "vegetation": 0.5, "object": 0.4, "other": 0.3}

#: Sound families of labels; the first that lists a label wins.
SOUND_FAMILIES = _groups("""
human: person, man, woman, child, boy, girl, people, crowd, audience, vendor, worker, player, pedestrian, rider
animal: animal, horse, donkey, cow, sheep, goat, dog, cat, bird, zebra, lion, tiger, giraffe, elephant, bear, duck, chicken
vehicle: vehicle, car, bus, truck, bicycle, motorcycle, cart, wagon, wooden cart, boat, ship, train, tram, tractor, wheelchair, forklift, van, taxi, scooter
water: water, river, lake, pond, creek, waterfall, sea, ocean, wave, canal, harbor, beach, coast
music_instrument: instrument, microphone, speaker, guitar, drum, violin, piano, accordion, flute, trumpet, saxophone
tool_machinery: tool, farm tool, plow, machine, engine, pipe, crane, forklift, equipment, medical equipment, computer, monitor, traffic light, street lamp, lamp, cooking pot, sink
food_market: food, bread, fruit, vegetable, vegetables, grain, hay, basket, crate, market stall, stand
built_context: building, house, church, cathedral, temple, tower, bell tower, wall, stone wall, fence, gate, door, window, bridge, barn, stable, corral, animal pen, monument, statue, arch, column, altar, grave, boathouse, dock, pier, gazebo, lifeguard tower, street, road, sidewalk, crosswalk, stage, desk, table, chair, bench, cabinet, counter, screen, display
nature_context: tree, plant, grass, flower, crop, field crop, bush, forest, field, rock, sky, mountain, sand, path, trail, lawn, log
""")
#: Families of labels for scenes.
SCENE_FAMILIES = _groups("""
human: person, man, woman, child, boy, girl, people, crowd, audience, vendor, worker, player, pedestrian, rider
animal: animal, horse, donkey, cow, sheep, goat, dog, cat, bird, zebra, lion, tiger, giraffe, elephant, bear, duck, chicken
vehicle: vehicle, car, bus, truck, bicycle, motorcycle, cart, wagon, wooden cart, boat, ship, train, tram, tractor, wheelchair, forklift, van, taxi, scooter, airplane, plane
water: water, river, lake, pond, creek, waterfall, sea, ocean, wave, canal, harbor, beach, coast, stream
music_instrument: instrument, microphone, speaker, guitar, drum, violin, piano, accordion, flute, trumpet, saxophone, tambourine, bongo
tool_machinery: tool, farm tool, plow, machine, engine, pipe, crane, forklift, equipment, medical equipment, computer, monitor, traffic light, street lamp, lamp, cooking pot, sink, wrench, turbine
food_market: food, bread, fruit, vegetable, vegetables, grain, hay, basket, crate, market stall, stand, plate, bowl, drink, sandwich
built_context: building, house, church, cathedral, temple, tower, bell tower, wall, stone wall, fence, gate, door, window, bridge, barn, stable, corral, animal pen, monument, statue, arch, column, altar, grave, boathouse, dock, pier, gazebo, lifeguard tower, street, road, sidewalk, crosswalk, stage, desk, table, chair, bench, cabinet, counter, screen, display, storefront, shopfront
nature_context: tree, plant, grass, flower, crop, field crop, bush, forest, field, rock, sky, mountain, sand, path, trail, lawn, log, hill, shore, snow, beach
""")
#: Family of a category, for labels no family lists.
CATEGORY_FAMILY = {"human": "human", "animal": "animal", "vehicle": "vehicle", "structure": "built_context", "vegetation": "nature_context", "tool": "tool_machinery", "food": "food_market"}
FAMILY_WEIGHTS = {"human": 1.0, "animal": 0.95, "vehicle": 0.95, "water": 0.9, "music_instrument": 0.9, "tool_machinery": 0.75, "food_market": 0.55, "nature_context": 0.45, "built_context": 0.35}
NO_FAMILY_WEIGHT = 0.2
DISCRETE_FAMILIES = ["human", "animal", "vehicle", "water", "music_instrument", "tool_machinery", "food_market"]
#: Labels whose importance is not their family's.
LABEL_WEIGHT_OF = {
    "crowd": 1.00, "audience": 0.95, "person": 0.90, "man": 0.85, "woman": 0.85, "child": 0.85, "vendor": 0.80,
    "horse": 0.95, "cow": 0.90, "sheep": 0.85, "goat": 0.85, "dog": 0.80, "bird": 0.75, "cat": 0.65,
    "tractor": 1.00, "truck": 0.95, "bus": 0.95, "train": 0.95, "tram": 0.90, "car": 0.85, "motorcycle": 0.85, "boat": 0.85, "ship": 0.85, "wagon": 0.80, "cart": 0.75,
    "bicycle": 0.55, "wheelchair": 0.45,
    "waterfall": 1.00, "river": 0.90, "sea": 0.90, "ocean": 0.90, "wave": 0.85, "water": 0.75, "lake": 0.70,
    "machine": 0.90, "engine": 0.90, "crane": 0.85, "forklift": 0.85, "instrument": 0.90, "speaker": 0.80, "microphone": 0.75, "tool": 0.70, "farm tool": 0.75, "plow": 0.80,
    "traffic light": 0.45, "street lamp": 0.25,
    "market stall": 0.65, "stand": 0.55, "basket": 0.45, "crate": 0.45, "food": 0.50, "bread": 0.45, "fruit": 0.40, "vegetables": 0.40,
    "forest": 0.55, "tree": 0.40, "field": 0.45, "field crop": 0.45, "grass": 0.25, "sky": 0.15, "road": 0.35, "street": 0.35, "building": 0.30, "house": 0.35, "church": 0.45,
    "barn": 0.45, "stable": 0.45, "bench": 0.15, "bag": 0.10, "window": 0.10, "door": 0.15,
}
#: Families of verbs, the first that lists a verb wins; other verbs are of OTHER_VERB.
VERB_FAMILIES = _groups("""
object_manipulation: hold, holding, carry, carrying, use, using, wear, wearing, touch, touching, grab, grabbing, cut, cutting, wash, washing, throw, throwing, catch, catching, inspect, open, opening, close, closing, control, operate, operating
locomotion_transport: ride, riding, sit on, sitting on, drive, driving, walk, walking, stand, standing, stand next to, standing next to, push, pushing, pull, pulling, board, boarding, exit, enter, park, parking, straddle, run, running, jump, jumping
food_activity: eat, eating, drink, drinking, cook, cooking, cut, cutting, prepare, preparing, feed, feeding, serve, serving
music_performance: play, playing, sing, singing, perform, performing
animal_handling: ride horse, hold horse, lead, leading, feed, feeding, pet, petting, walk dog, herd, herding
social_attention: look, looking, look at, looking at, watch, watching, talk, talking, listen, listening, point, pointing
""")
OTHER_VERB = "other_interaction"

#: Scene groups, with the families expected there and their ambience.
SCENE_EXPECTED = _groups("""
rural_traditional: human, animal, vehicle, tool_machinery, food_market, nature_context, built_context
natural_outdoor: human, animal, water, nature_context
market_public: human, food_market, built_context, vehicle, tool_machinery
religious_heritage: human, built_context, music_instrument
indoor_domestic: human, food_market, tool_machinery, built_context
urban_transport: human, vehicle, tool_machinery, built_context
coastal_water: human, vehicle, water, nature_context, built_context
public_indoor: human, built_context, food_market, music_instrument, tool_machinery
education_health_office: human, built_context, tool_machinery
sports_recreation: human, built_context, tool_machinery, nature_context
industrial_workshop: human, vehicle, tool_machinery, built_context
garden_park: human, animal, water, nature_context, built_context
entertainment_culture: human, music_instrument, tool_machinery, built_context
""")
INDOOR_GROUPS = ["indoor_domestic", "public_indoor", "education_health_office"]
AMBIENCE = {
    "rural_traditional": "rural/traditional ambience", "natural_outdoor": "nature ambience", "market_public": "public market/crowd ambience",
    "religious_heritage": "heritage/reverberant ambience", "indoor_domestic": "indoor domestic ambience", "urban_transport": "urban/traffic ambience",
    "coastal_water": "coastal/water ambience", "public_indoor": "public indoor ambience", "education_health_office": "institutional indoor ambience",
    "sports_recreation": "sports/recreation ambience", "industrial_workshop": "industrial/mechanical ambience", "garden_park": "garden/park ambience",
    "entertainment_culture": "performance/cultural ambience",
}

#: Labels that take no part in spatial relations (background), and those that always do.
SPATIAL_LABELS = _groups("""
background: sky, field, field crop, crop, ground, grass, road, street, path, trail, water, river, lake, pond, creek, waterfall, sea, ocean, coast, beach, sand, snow, mountain, valley, forest, bush, plant, tree, flower, rock, log, lawn, wall, floor, ceiling, sidewalk, crosswalk, bridge, railroad track, rail, dock, pier, stage, screen, counter, desk, court, market stall, stand, awning, queue barrier, display, metal structure, pipe, container, gazebo, fountain
compact: person, man, woman, child, crowd, vendor, lifeguard, audience, horse, donkey, cow, sheep, goat, dog, cat, bird, zebra, car, bus, truck, bicycle, motorcycle, cart, wagon, wooden cart, boat, ship, train, tram, tractor, wheelchair, forklift, table, chair, bench, basket, bag, bucket, barrel, box, tool, farm tool, instrument, umbrella, food, bread, fruit, vegetable, vegetables, crate, sign, traffic light, street sign, ball, goal, net, helmet, equipment, machine, engine, crane, speaker, light, microphone, book, monitor, computer, whiteboard, medical equipment, cabinet, lamp, cooking pot, bowl, sink
structure: building, house, church, cathedral, temple, tower, bell tower, gate, door, window, fence, barn, stable, corral, animal pen, cottage, cabin, boathouse, castle, palace, ruin, monument, statue, arch, column, altar, grave
""")
INVERSES = {"left_of": "right_of", "right_of": "left_of", "above": "below", "below": "above"}
SYMMETRIC = ["overlapping"]
#: Labels that stand for the same thing where boxes overlap.
ALIAS_GROUPS = _groups("""
human: person, man, woman, child
animal: horse, donkey, cow, sheep
vehicle: cart, wagon, cart wagon
""")

#: Singular forms the rules of suffixes get wrong, and nouns that stay as they are.
IRREGULAR_SINGULARS = {
    "people": "person", "men": "man", "women": "woman", "children": "child", "mice": "mouse", "geese": "goose", "teeth": "tooth", "feet": "foot", "oxen": "ox",
    "cacti": "cactus", "fungi": "fungus", "knives": "knife", "wives": "wife", "lives": "life", "leaves": "leaf", "loaves": "loaf", "halves": "half", "shelves": "shelf",
    "wolves": "wolf", "calves": "calf", "thieves": "thief", "scarves": "scarf", "hooves": "hoof", "elves": "elf", "banjoes": "banjo", "mosquitoes": "mosquito",
    "volcanoes": "volcano", "velcroes": "velcro", "potatoes": "potato", "tomatoes": "tomato", "heroes": "hero", "echoes": "echo", "torpedoes": "torpedo",
    "buffaloes": "buffalo", "dominoes": "domino", "mangoes": "mango", "flamingoes": "flamingo", "zeroes": "zero", "buses": "bus", "busses": "bus", "gases": "gas",
    "lenses": "lens", "atlases": "atlas", "canvases": "canvas", "christmases": "christmas", "thermoses": "thermos", "platypuses": "platypus", "daises": "dais",
    "viruses": "virus", "cactuses": "cactus", "octopuses": "octopus", "walruses": "walrus", "circuses": "circus", "irises": "iris", "quizzes": "quiz", "waltzes": "waltz",
    "movies": "movie", "cookies": "cookie", "pies": "pie", "ties": "tie", "lies": "lie", "brownies": "brownie", "zombies": "zombie", "hoodies": "hoodie",
    "selfies": "selfie", "calories": "calorie", "veggies": "veggie", "neckties": "necktie", "bowties": "bowtie", "crossties": "crosstie", "twinkies": "twinkie",
    "freebies": "freebie", "weenies": "weenie", "aches": "ache", "quiches": "quiche", "crevasses": "crevasse", "headaches": "headache", "moustaches": "moustache",
    "mustaches": "mustache", "avalanches": "avalanche", "niches": "niche", "caches": "cache", "menus": "menu", "emus": "emu", "gnus": "gnu", "tutus": "tutu",
    "plateaus": "plateau",
}
INVARIANT_NOUNS = (
    "lens gas atlas canvas christmas news series species bias chaos cosmos rhinoceros thermos tennis iris dais axis chassis trellis pelvis oasis"
).split()
#: Words of the caption template, which name no object.
TEMPLATE_WORDS = ["image", "scene", "shows", "show", "indoor", "outdoor", "mixed"]
#: How a verb stands in a caption.
VERB_FORMS = {
    "hold": "holds", "holding": "holds", "ride": "rides", "riding": "rides", "sit on": "sits on", "sitting on": "sits on", "stand next to": "stands next to",
    "standing next to": "stands next to", "look at": "looks at", "looking at": "looks at", "carry": "carries", "carrying": "carries", "use": "uses", "using": "uses",
}


def first_match(groups: dict[str, list[str]]) -> dict[str, str]:
    """Member -> the first group that lists it."""
    out: dict[str, str] = {}
    for group, members in groups.items():
        for m in members:
            out.setdefault(m, group)
    return out


def lookup(table: dict, key: Column, default: object = None) -> Column:
    """The value of a small fixed table, as a MAP literal: no join, no shuffle."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


CATEGORY_OF = first_match(CATEGORIES)
SOUND_FAMILY_OF = first_match(SOUND_FAMILIES)
SCENE_FAMILY_OF = first_match(SCENE_FAMILIES)
VERB_FAMILY_OF = first_match(VERB_FAMILIES)
ALIAS_GROUP_OF = first_match(ALIAS_GROUPS)
