"""Word lists behind the text features."""

# Every list decides feature values and is matched word for word.

POSITIVE = (
    "love great perfect amazing excellent wonderful recommend best beautiful happy "
    "satisfied favorite awesome fantastic comfortable flattering gorgeous stunning "
    "brilliant superb pleased delighted thrilled outstanding"
).split()
NEGATIVE = (
    "hate terrible awful disappointed bad poor worst never return cheap ugly "
    "uncomfortable wrong misleading horrible defective ripped stained faded scratchy "
    "itchy ill-fitting overpriced underwhelming regret waste"
).split()
INTENSIFIERS = (
    "very really extremely incredibly absolutely totally utterly highly so too "
    "especially exceptionally particularly"
).split()
NEGATIONS = (
    "not never no nor neither nowhere nothing nobody hardly barely scarcely without "
    "isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't "
    "shouldn't"
).split()
FIRST_PERSON = "i me my mine myself".split()
FIT = (
    "fit fits fitted fitting size sized sizing tight loose snug oversized petite plus "
    "true-to-size tts runs small large boxy tailored"
).split()
QUALITY = (
    "quality material fabric construction stitch seam durable durability craftsmanship "
    "premium cheap flimsy sheer transparent lining"
).split()
PRICE = (
    "price priced pricing expensive costly affordable value worth money overpriced "
    "underpriced sale discount bargain steal"
).split()
SHIPPING = (
    "shipping shipped delivery arrived package packaging transit delay late early fast "
    "slow courier"
).split()
RETURN = "return returned returning refund exchange send back".split()
RECOMMEND_PHRASES = [
    "would recommend", "highly recommend", "recommend to", "recommend this",
    "tell friends", "buy again", "purchase again",
]

COLOR = (
    "red blue green black white pink purple yellow orange brown gray grey beige navy "
    "teal burgundy cream ivory gold silver olive tan coral mint lavender maroon charcoal "
    "rust mustard plum turquoise"
).split()
PATTERN = (
    "striped stripe floral print plaid dotted solid pattern graphic logo paisley "
    "checkered herringbone textured lace embroidered"
).split()
FABRIC = (
    "cotton silk wool polyester linen denim leather suede velvet chiffon satin jersey "
    "knit cashmere fleece spandex rayon mesh sheer lace"
).split()
GARMENT = (
    "neckline sleeve hem waist pocket button zipper collar cuff pleat ruffle stretchy "
    "flowy lined unlined padded hooded cropped long short"
).split()
BRIGHTNESS_PRESENCE = "bright dark vivid dull faded".split()
SILHOUETTE_PRESENCE = "oversized cropped long short boxy flattering".split()
TEXTURE_PRESENCE = "soft rough silky scratchy smooth coarse".split()
DAMAGE_PRESENCE = "stain tear hole pilling snag defect".split()
PHOTO_MATCH_PHRASES = ["as pictured", "true to color", "matches photo"]
PHOTO_MISMATCH_PHRASES = [
    "different than", "not as pictured", "not as shown", "color off", "wrong color",
    "misleading photo", "looks different",
]

# End of fixed values.

COUNTED = {
    "nlp_sentiment_pos": POSITIVE,
    "nlp_sentiment_neg": NEGATIVE,
    "nlp_intensifier_count": INTENSIFIERS,
    "nlp_negation_count": NEGATIONS,
    "nlp_first_person_count": FIRST_PERSON,
    "nlp_fit_mentions": FIT,
    "nlp_quality_mentions": QUALITY,
    "nlp_price_mentions": PRICE,
    "nlp_shipping_mentions": SHIPPING,
    "nlp_return_mentions": RETURN,
    "vis_color_mentions": COLOR,
    "vis_pattern_mentions": PATTERN,
    "vis_fabric_mentions": FABRIC,
    "vis_garment_detail_mentions": GARMENT,
}
PRESENT = {
    "vis_brightness_language": BRIGHTNESS_PRESENCE,
    "vis_fit_visual_mentions": SILHOUETTE_PRESENCE,
    "vis_texture_mentions": TEXTURE_PRESENCE,
    "vis_stain_damage_mentions": DAMAGE_PRESENCE,
}
VOCABULARY = sorted({w for words in [*COUNTED.values(), *PRESENT.values()] for w in words})

# The English stop-word list that Apache Spark publishes with its StopWordsRemover.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()
# End of fixed values.
