"""Defaults of the pipeline. Every operator takes these as keyword arguments."""

# They must equal the published defaults for results to agree.
MIN_USER_RATINGS = 10
MIN_ITEM_RATINGS = 10
COLD_THRESHOLD = 20
TRAIN_RATIO = 0.8
VAL_RATIO = 0.1
RELEVANT_RATING = 4.0
TOP_KS = (5, 10, 20)
RATING_RANGE = (0.5, 5.0)
USER_PREFIX = "ML_"

ALS_RANK = 128
ALS_REG = 0.1
ALS_TOL = 1e-4
ALS_ITERATIONS = 10
BPR_LR = 1e-3
BPR_REG = 1e-4
BPR_EPOCHS = 20
BPR_BATCHES = 8   # own choice: steps per epoch
GCN_BATCHES = 2   # own choice: a step costs two propagations
NEGATIVE_TRIES = 20
VAL_SAMPLES_FLOOR = 10_000
EASE_REG = 350.0
GCN_DIM = 64
GCN_LAYERS = 2
GCN_REG = 1e-4
GCN_INIT_STD = 0.1
RANKER_DECAY = 1e-3
PATIENCE = 7
SCORE_TEMPERATURE = 5.0
HISTORY_LENGTH = 50
DECAY_BASE = 0.5
MIN_SEQUENCE = 3
SEED = 42

GENRES = (
    "Drama", "Comedy", "Thriller", "Action", "Romance",
    "Horror", "Crime", "Documentary", "Adventure", "Sci-Fi",
    "Mystery", "Fantasy", "Biography", "Animation", "Family",
    "History", "Music", "War", "Western", "Sport",
)
NO_GENRE = "(no genres listed)"
ACTIVITY_EDGES = (20, 50, 200, 500)
EXCLUDED_MODELS = ("SASRec",)
