"""Fixed values that results depend on.

These must equal the values the original analysis used, so they are stated
plainly, in their natural order, in one place.
"""

# ---------------------------------------------------------------------------
# Profile counter names (20 counters, fa .. ft).
# ---------------------------------------------------------------------------
PROFILE_COLUMNS = [
    "fa", "fb", "fc", "fd", "fe", "ff", "fg", "fh", "fi", "fj",
    "fk", "fl", "fm", "fn", "fo", "fp", "fq", "fr", "fs", "ft",
]

# ---------------------------------------------------------------------------
# The four city areas, (areaid, x_min, x_max, y_min, y_max).
# ---------------------------------------------------------------------------
AREA_BOXES = [
    (0, 121.44149, 121.48956, 31.2354, 31.30025),
    (1, 121.49814, 121.55445, 31.23981, 31.28999),
    (2, 121.4245, 121.49934, 31.18446, 31.23482),
    (3, 121.50621, 121.55977, 31.19018, 31.23658),
]

# ---------------------------------------------------------------------------
# Ten cluster centres (x, y) per area; list position = clusterid.
# ---------------------------------------------------------------------------
CLUSTER_CENTRES = {
    0: [
        (121.47904218021975, 31.27436613439561),
        (121.4822382, 31.242465427164177),
        (121.46295560847456, 31.268907813050856),
        (121.47989070408164, 31.292249250714285),
        (121.45070153015872, 31.2451486634127),
        (121.45020977500002, 31.289576749423084),
        (121.44969039230764, 31.26387677423077),
        (121.46505258314606, 31.250673503483142),
        (121.48237673983056, 31.25877582330509),
        (121.47152513499998, 31.238059283699982),
    ],
    1: [
        (121.54497624999998, 31.279527461136365),
        (121.54562910434782, 31.24945867739131),
        (121.52273102857141, 31.243289817346938),
        (121.50350558823527, 31.285694119411765),
        (121.50478317391305, 31.256429499130434),
        (121.50794794347829, 31.274031308695655),
        (121.51631573500002, 31.262953368499993),
        (121.50350845, 31.242291090185176),
        (121.52527335294117, 31.281408139411763),
        (121.53139298507465, 31.264620886567158),
    ],
    2: [
        (121.48775176810342, 31.226870036293093),
        (121.43753732790697, 31.226237231686042),
        (121.43246179481484, 31.192586475629632),
        (121.45436309874212, 31.22898911861635),
        (121.47196186949999, 31.22731812925001),
        (121.48546462410714, 31.203046577053577),
        (121.44844290000002, 31.195363215287358),
        (121.46792063923073, 31.20550328438461),
        (121.45229112400004, 31.213080561359995),
        (121.43183557291667, 31.21165184875),
    ],
    3: [
        (121.52187648039215, 31.231059664313722),
        (121.51504965714284, 31.19749158371429),
        (121.55043973333335, 31.209229098333328),
        (121.5122770906977, 31.230297268604662),
        (121.52864429887637, 31.225297347865173),
        (121.5136195622222, 31.21369013822222),
        (121.54395201166665, 31.226609231833336),
        (121.54822319090908, 31.195514252272734),
        (121.53635720454548, 31.212127111363635),
        (121.5247843088889, 31.208801892),
    ],
}

# ---------------------------------------------------------------------------
# Device periods without a change set. Period 1 has no earlier
# period; period 9 starts a new device-name format.
# ---------------------------------------------------------------------------
SKIPPED_PERIODS = (1, 9)

# ---------------------------------------------------------------------------
# Device record: its eleven fields, the five categories and two numbers that
# the forest reads, and the period scored.
# ---------------------------------------------------------------------------
DEVICE_COLUMNS = [
    ("period", "int"), ("user_id", "bigint"), ("net", "string"), ("gender", "string"), ("age", "string"),
    ("arpu", "string"), ("vendor", "string"), ("dtype", "string"), ("bytes", "string"), ("voice", "int"), ("sms", "int"),
]
DEVICE_FIELDS = [name for name, _ in DEVICE_COLUMNS]
DEVICE_BEHAVIOUR = DEVICE_FIELDS[2:]
CATEGORY_COLUMNS = ["net", "gender", "age", "arpu", "vendor", "dtype", "bytes"]
DEVICE_CATEGORICAL = ["net", "gender", "age", "arpu", "bytes"]
DEVICE_NUMERIC = ["voice", "sms"]
LAST_PERIOD = 12

# ---------------------------------------------------------------------------
# Random-forest settings of the original training run, and the
# grid searched with 3-fold cross-validation.
# ---------------------------------------------------------------------------
FOREST_PARAMS = {"numTrees": 24, "maxDepth": 30, "maxBins": 30,
                 "impurity": "entropy", "featureSubsetStrategy": "auto", "seed": 1}
FOREST_GRID = {"numTrees": [32], "maxDepth": [20, 30], "maxBins": [20],
               "impurity": ["entropy"]}
CV_FOLDS = 3
