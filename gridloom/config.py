"""Constants and parameter profiles. Values marked fixed must equal those that results are compared with."""

from __future__ import annotations

from dataclasses import dataclass

# Seed, map presets, search grids, bins and fill words.
SEED = 42
SIZE_PRESETS = (
    # rows above, side, learning rate, sigma, iterations
    (100_000, 25, 0.3, 1.2, 1000),
    (50_000, 30, 0.4, 1.5, 1500),
    (-1, 35, 0.5, 1.8, 2000),
)
FALLBACK = {"som_x": 20, "som_y": 20, "learning_rate": 0.2, "sigma": 0.8, "iterations": 500}
FALLBACK_ROWS = 30_000
SETTINGS_GRID = {"som_x": [15, 20, 25], "som_y": [15, 20, 25], "sigma": [0.8, 1.0, 1.2], "learning_rate": [0.3, 0.5, 0.7], "iterations": [500, 1000, 1500]}
FULL_GRID = {"som_x": [20, 25, 30], "som_y": [20, 25, 30], "sigma": [0.8, 1.0, 1.2], "learning_rate": [0.3, 0.5, 0.7], "iterations": [1000, 2000, 3000]}
FAST_GRID = {"som_x": [15, 20], "som_y": [15, 20], "sigma": [0.8, 1.0], "learning_rate": [0.3, 0.5], "iterations": [500, 1000]}
FILL = "NÃO_INFORMADO"
OTHER = "OUTROS"
MISSING_BIN = "nan"
LEVELS_BEFORE_CAP, LEVELS_KEPT = 20, 15
PERIODS = ((-1, 5, "Madrugada"), (5, 9, "Manhã Cedo"), (9, 12, "Manhã"), (12, 15, "Tarde Cedo"), (15, 18, "Tarde"), (18, 21, "Noite"), (21, 24, "Noite Tardia"))
AGES = ((0, 18, "0-18"), (18, 30, "19-30"), (30, 45, "31-45"), (45, 60, "46-60"), (60, 100, "61-100"), (100, 200, "100+"))
CATEGORICAL = ("SEXO_PESSOA", "COR_PELE", "TIPO_VEICULO", "TIPO_LOCAL", "NATUREZA_APURADA", "CIDADE", "BAIRRO", "UF")


@dataclass(frozen=True)
class Profile:
    """What differs between the two parameter profiles."""

    density_threshold: float = 0.7
    min_cluster_ratio: float | None = 0.005  # None: the caller's ratio counts
    default_ratio: float = 0.01
    thinning: bool = True
    iterations: int = 1000
    map_size: int | None = 20  # None: by number of rows
    full_budget: int = 15
    fast_budget: int | None = 8


CANONICAL = Profile()
LEGACY = Profile(0.3, None, 0.01, False, 5000, None, 20, None)
