"""Text catalogs, tables, logs and configuration.

Catalogs are read with Spark's text source and split into columns, so files of any size are read in parallel; header lines
are those that don't start with a number.  Configuration is short and read on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eEdD][-+]?\d+)?(\s|$)"

# The columns of catalogs and tables, in the order of the files.
HALO_COLUMNS = (
    "x y z vx vy vz mbound mtot rvir vrms vcirc halo_no conc npart idist xoff virrat spin radrms ba ca xax yax zax"
).split()
HALO_INTS = {"halo_no", "npart", "idist"}
GALAXY_COLUMNS = "x y z vx vy vz dens".split()
SPECTRUM_COLUMNS = "bin k n_modes pk p0 p2".split()
#: Legal ranges of a halo catalog's columns.
HALO_LIMITS = {"mbound": (1e7, 1e16), "vcirc": (0.0, 1e4), "idist": (0.0, 2e9)}


def fields_of(lines: DataFrame, columns: list[str], ints: set[str] = frozenset(), value: str = "value") -> DataFrame:
    """Columns of lines that start with a number and have that many fields at least."""
    own = lines.where(F.col(value).rlike(NUMBER)).withColumn("__f", F.split(F.trim(F.regexp_replace(value, r"(?i)(\d)d([-+]?\d)", "$1e$2")), r"[\s,]+"))
    cast = lambda i, c: F.get("__f", F.lit(i)).cast("long" if c in ints else "double").alias(c)
    keep = [c for c in lines.columns if c != value]
    return own.where(F.size("__f") >= len(columns)).select(*keep, *[cast(i, c) for i, c in enumerate(columns)])


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value) of all files of a path, a glob or a list: parts of one catalog are read together."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def read_halos(spark: SparkSession, path, least_vcirc: float = 0.0, columns: list[str] = HALO_COLUMNS) -> DataFrame:
    """A halo catalog with is_distinct; halos of a smaller circular velocity are left out."""
    out = fields_of(lines_of(spark, path), columns, HALO_INTS).where(F.col("vcirc") > least_vcirc)
    return out.withColumn("is_distinct", F.col("idist") == 0)


def read_galaxies(spark: SparkSession, path) -> DataFrame:
    return fields_of(lines_of(spark, path), GALAXY_COLUMNS)


def read_spectra(spark: SparkSession, path, columns: list[str] = SPECTRUM_COLUMNS[:4]) -> DataFrame:
    """Tables of power spectra with realization: the order of their files' names."""
    rows = fields_of(lines_of(spark, path), columns, {"bin", "n_modes"})
    files = sorted(r[0] for r in rows.select("file").distinct().collect())  # a row a file
    table = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, realization long")
    return rows.join(F.broadcast(table), "file")


def read_listed(spark: SparkSession, list_path: str, columns: list[str], ints: set[str] = frozenset()) -> DataFrame:
    """The tables that a list names, with realization: their place in the list.  The list: their number, then a name a line.

    Names that aren't absolute are beside the list.
    """
    lines = [r[0].strip() for r in spark.read.text(list_path).coalesce(1).collect()]  # a line a file
    lines = [x for x in lines if x]
    named = lines[1 : 1 + int(lines[0].split()[0])]
    if len(named) < int(lines[0].split()[0]):
        raise ValueError(f"the list has {len(named)} names of {lines[0]}")
    folder = list_path.rpartition("/")[0] or "."
    paths = [x if x.startswith("/") or "://" in x else f"{folder}/{x}" for x in named]
    at = {x.rpartition("/")[2]: i for i, x in enumerate(paths)}
    if len(at) < len(paths):
        raise ValueError("a file is listed twice")
    table = spark.createDataFrame(list(at.items()), "name string, realization long")
    rows = fields_of(lines_of(spark, paths), columns, ints).withColumn("name", F.url_decode(F.substring_index("file", "/", -1)))
    return rows.join(F.broadcast(table), "name").drop("name")


def corrected(spectra: DataFrame, box: float, mesh: float, rows: float, value: str = "pk") -> DataFrame:
    """spectra with the assignment's damping undone and the shot noise of rows**3 points taken away."""
    s = F.sin(F.col("k") * (box / (2.0 * mesh)))
    return spectra.withColumn(value, F.col(value) / (1 - 0.667 * s * s) - (box / rows) ** 3)


BISPECTRUM_COLUMNS = "k1 k2 k3 n b".split()


def read_bispectra(spark: SparkSession, list_path: str) -> DataFrame:
    return read_listed(spark, list_path, BISPECTRUM_COLUMNS)


def reformatted(halos: DataFrame, omega_m: float, a: float, overdensity: float, mass_ratio) -> DataFrame:
    """A catalog's columns with m500c and m200c: masses within 500 and 200 times the critical density.

    overdensity: the catalog's, against the mean density; mass_ratio(conc, ratio): the mass at ratio times that overdensity
    over the one at it.
    """
    critical = overdensity * omega_m / (omega_m + (1 - omega_m) * a**3)
    out = halos.withColumns({f"m{d}c": F.col("mtot") * mass_ratio("conc", F.lit(d / critical)) for d in (500, 200)})
    return out.select(*"x y z vx vy vz mbound mtot m500c m200c rvir vrms vcirc conc xoff spin".split())


def write_profiles(profiles: DataFrame, halos: DataFrame, path: str, particle_mass: float, keep: int = 100) -> None:
    """Profiles as Parquet, a row a halo with the array of its shells, of halos of over `keep` particles of mass mvir.

    profiles: (halo, shell, n, mass, enclosed, radius); shells without points, or of five particles' mass or less inside,
    are left out.
    """
    some = profiles.where((F.col("n") > 0) & (F.col("enclosed") > 5 * particle_mass))
    shells = some.groupBy("halo").agg(F.array_sort(F.collect_list(F.struct("shell", "radius", "n", "mass", "enclosed"))).alias("shells"))
    halos.where(F.col("mvir") > keep * particle_mass).join(shells, "halo", "left").write.parquet(path)


def write_projections(planes: DataFrame, path: str) -> None:
    """(plane, a, b, dens) as Parquet, a folder a plane, each row of a plane an array along b."""
    rows = planes.groupBy("plane", "a").agg(F.array_sort(F.collect_list(F.struct("b", "dens"))).getField("dens").alias("dens"))
    rows.write.partitionBy("plane").parquet(path)


def read_rockstar(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """A RockStar list, whose comments start with #; is_distinct where the parent id (pid) is negative."""
    lines = lines_of(spark, path).where(~F.col("value").startswith("#"))
    return fields_of(lines, columns, {"id", "pid"}).withColumn("is_distinct", F.col("pid") < 0)


def write_columns(df: DataFrame, path: str, header: str = "", rows_per_file: int | None = None) -> None:
    """Rows as text, columns apart by blanks, a header line in each file."""
    cells = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])
    out = df.select(F.regexp_replace(cells, "\n", " ").alias("line"))
    writer = out.withColumnRenamed("line", header or " ".join(df.columns)).write.option("header", bool(header)).option("quote", "").option("sep", "\t")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).csv(path)


def select_for_catalog(halos: DataFrame, least_mass: float, particle_mass: float, box: float) -> DataFrame:
    """Halos that a catalog holds: heavy enough, of ten particles at least, inside the box."""
    inside = [(F.col(c) >= 0) & (F.col(c) < box) for c in "xyz"]
    return halos.where((F.col("mbound") >= max(least_mass, 20 * particle_mass)) & (F.col("npart") >= 10) & inside[0] & inside[1] & inside[2])


# ---- lines ------------------------------------------------------------------------------------------------------------


def after_last_equals(line: Column) -> Column:
    return F.trim(F.substring_index(line, "=", -1))


def header_pair(line: Column, name: str) -> Column:
    """The number that follows `name =` in a line; null without it."""
    return F.nullif(F.regexp_extract(line, rf"{re.escape(name)}\s*=\s*([-+0-9.eE]+)", 1), F.lit("")).cast("double")


def parse_residuals(lines: DataFrame, value: str = "value") -> DataFrame:
    """(residual, cycles) of lines that tell them."""
    pattern = r"residual is equal to\s+([-+0-9.eEdD]+)\s+after\s+(\d+)"
    own = lines.where(F.col(value).rlike(pattern))
    keep = [c for c in lines.columns if c != value]
    return own.select(*keep, F.regexp_replace(F.regexp_extract(value, pattern, 1), "[dD]", "e").cast("double").alias("residual"), F.regexp_extract(value, pattern, 2).cast("long").alias("cycles"))


# The columns of a timing log after the step's number.
PHASES = "total force move density io bias halos analysis field".split()


def parse_timing(lines: DataFrame, value: str = "value") -> DataFrame:
    """(step, minutes by phase) of a timing log; its two header lines start with words."""
    return fields_of(lines, ["step", *PHASES], {"step"}, value)


# ---- configuration ----------------------------------------------------------------------------------------------------


def parse_value(text: str):
    text = text.strip()
    if text.lower() in ("t", "true", ".true.", "yes"):
        return True
    if text.lower() in ("f", "false", ".false.", "no"):
        return False
    for kind in (int, float):
        try:
            return kind(text.replace("d", "e") if kind is float else text)
        except ValueError:
            pass
    return text


def parse_pairs(text: str) -> dict:
    """key = value lines; what follows ! or # is a comment; the value is what follows the last =."""
    out = {}
    for line in text.splitlines():
        line = re.split(r"[!#]", line, maxsplit=1)[0]
        if "=" in line:
            key, value = line.rsplit("=", 1)
            out[key.strip().lower()] = parse_value(value)
    return out


def first_value(line: str):
    """The first value of a line; what follows it is a note."""
    parts = re.split(r"[\s,!]+", line.strip(), maxsplit=1)
    return parse_value(parts[0]) if parts[0] else None


# The fields of a run's settings in the order of the file, by section.
RUN = "a_init a_step sigma box sigma8 hubble omega_m omega_l omega_b n_rows n_grid seed cell particle_mass z_init z_final density_threshold sigma_v".split()
OUTPUT = "checkpoint_steps save_snapshots power power_rsd density bias write_mock dump_particles halos".split()
FIELD = "field_on field_test field_model v_cycle f_cycle w_cycle most_cycles residual_limit".split()
MODELS = ("fr_n fr_0", "dgp_normal dgp_accelerating dgp_h0rc", "sym_a sym_xi sym_beta", "kmf_power_law kmf_born_infeld kmf_n kmf_k0 kmf_beta", "csf_coupling csf_potential csf_alpha csf_beta")
PHASE = "amplitude_mode reverse_phases".split()
# What a file that ends before its outputs or its phases means.
OUTPUT_DEFAULTS = dict(zip(OUTPUT, (20, 0, 1, 0, 1, 0, 0, 0, 0), strict=True))
PHASE_DEFAULTS = {"amplitude_mode": 1, "reverse_phases": 0}
# The names and settings of a new input file, in the order of the file.
INPUT_DEFAULTS = (
    ("Box", "box", 1000.0), ("Nrow", "n_rows", 1000), ("Ngrid", "n_grid", 2000), ("sig8", "sigma8", 0.8159), ("z_init", "z_init", 100.0),
    ("step da", "a_step", 4e-4), ("z_final", "z_final", 0.0), ("#outputs", "redshifts", (2.5, 1.5, 1.0, 0.8, 0.7, 0.5, 0.3, 0.2, 0.1, 0.0)),
    ("dens_thr", "density_threshold", 30.0), ("Vrms", "sigma_v", 0.0), ("#Params", "bias", (0.0,) * 9 + (1.0,)),
    ("Steps between checkpoints", "checkpoint_steps", 20), ("Save snapshots", "save_snapshots", 1), ("DM power spectrum", "power", 0),
    ("Redshift distortions", "power_rsd", 0), ("DM PDF", "density", 0), ("Biasing model", "bias_model", 0), ("Write Mocks", "write_mock", 0),
    ("Dump random fraction", "dump_particles", 0), ("Find BDM halos", "halos", 0), ("MG_flag", "field_on", 0), ("MG_test", "field_test", 0),
    ("MG_model", "field_model", 1), ("Vcycle", "v_cycle", 1), ("Fcycle", "f_cycle", 0), ("Wcycle", "w_cycle", 0), ("iter_count_max", "most_cycles", 2),
    ("res_conv", "residual_limit", 1e-8), ("fR_n", "fr_n", 1), ("fR0", "fr_0", -1e-5), ("N_branch", "dgp_normal", 0), ("S_branch", "dgp_accelerating", 0),
    ("H0rc", "dgp_h0rc", 1.0), ("sym_astar", "sym_a", 0.5), ("sym_xi", "sym_xi", 0.001), ("sym_beta", "sym_beta", 0.1), ("power_law", "kmf_power_law", 0),
    ("born_infeld", "kmf_born_infeld", 0), ("kmf_n", "kmf_n", 3), ("kmf_K0", "kmf_k0", 1.0), ("kmf_beta", "kmf_beta", 0.1),
    ("csf_coupling", "csf_coupling", 1), ("csf_potential", "csf_potential", 1), ("csf_alpha", "csf_alpha", 0.1), ("csf_beta", "csf_beta", -0.2),
    ("Amplitude_mode", "amplitude_mode", 1), ("Reverse_phases", "reverse_phases", 0),
)


class _Lines:
    """The lines of a positional file, one after another."""

    def __init__(self, text: str):
        self.rows, self.at = text.splitlines(), 0

    def line(self) -> str | None:
        self.at += 1
        return self.rows[self.at - 1] if self.at <= len(self.rows) else None

    def value(self):
        line = self.line()
        if line is None or first_value(line) is None:
            raise ValueError(f"line {self.at} has no value")
        return first_value(line)

    def values(self, n: int) -> list[float]:
        """n numbers, over as many lines as they take."""
        out: list[float] = []
        while len(out) < n:
            line = self.line()
            if line is None:
                raise ValueError(f"{n} values were told, {len(out)} found")
            out += [float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", line.split("!")[0])]
        return out[:n]

    def done(self) -> bool:
        return self.at >= len(self.rows)


@dataclass
class Setup:
    """Settings of a run, as its positional file has them: a line each, by section, the first value of a line counts.

    title and header are the first two lines.  A file that ends before the outputs, or before the amplitude mode, has
    their defaults; appended says whether the outputs' were taken, and text() then holds them.
    """

    title: str = ""
    header: str = ""
    values: dict = field(default_factory=dict)
    redshifts: list[float] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    appended: bool = False

    def __getattr__(self, name: str):
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    @classmethod
    def parse(cls, text: str) -> Setup:
        rows, out = _Lines(text), cls()
        out.title, out.header = (rows.line() or "").strip(), (rows.line() or "").strip()
        for name in RUN:
            out.values[name] = rows.value()
        out.redshifts = rows.values(int(rows.value()))
        out.bias = [float(rows.value()) for _ in range(int(rows.value()))]
        if rows.done():
            out.appended = True
            out.values |= OUTPUT_DEFAULTS | PHASE_DEFAULTS
            return out
        for name in OUTPUT:
            out.values[name] = rows.value()
        for section in (" ".join(FIELD), *MODELS):
            rows.line()
            for name in section.split():
                out.values[name] = rows.value()
        out.values |= PHASE_DEFAULTS
        if not rows.done():
            rows.line()
            for name in PHASE:
                if not rows.done():
                    out.values[name] = rows.value()
        return out

    def text(self) -> str:
        show = lambda v: {True: "T", False: "F"}.get(v, str(v)) if isinstance(v, bool) else str(v)
        line = lambda name: f"{show(self.values[name]):<18} {name}"
        out = [self.title, self.header, *map(line, RUN), f"{len(self.redshifts):<18} number of redshifts", " ".join(map(str, self.redshifts))]
        out += [f"{len(self.bias):<18} number of bias parameters", *[f"{b:<18} bias parameter" for b in self.bias], *map(line, OUTPUT)]
        for title, section in zip(("field", "f(R)", "DGP", "symmetron", "k-mouflage", "coupled scalar"), (" ".join(FIELD), *MODELS), strict=True):
            if all(n in self.values for n in section.split()):
                out += [f"---- {title}", *map(line, section.split())]
        if "field_on" in self.values:
            out += ["---- phases", *map(line, PHASE)]
        return "\n".join(out) + "\n"


@dataclass
class Inputs:
    """Settings from which a run is set up: name = value lines in a fixed order; the redshifts follow their number."""

    values: dict = field(default_factory=lambda: {key: list(v) if isinstance(v, tuple) else v for _, key, v in INPUT_DEFAULTS})

    def __getattr__(self, name: str):
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    @classmethod
    def parse(cls, text: str) -> Inputs:
        """By position, whatever the names; the value is the first after the last =.  A missing end has its defaults."""
        rows, out = _Lines(text), cls()
        after = lambda line: first_value(line.rsplit("=", 1)[-1])
        for _, key, default in INPUT_DEFAULTS:
            line = rows.line()
            if line is None or not line.strip():
                if key in PHASE:
                    break
                raise ValueError(f"no line for {key}")
            value = after(line)
            if key == "redshifts":
                out.values[key] = rows.values(int(value))
            elif key == "bias":
                out.values[key] = [float(after(rows.line() or "0")) for _ in range(int(value))]
                if len(out.values[key]) >= 10 and out.values[key][9] < 0.1:
                    out.values[key][9] = 1.0
            else:
                out.values[key] = type(default)(value)
        return out

    def text(self) -> str:
        out = []
        for name, key, _ in INPUT_DEFAULTS:
            v = self.values[key]
            if key == "redshifts":
                out += [f"{name:<9}= {len(v)}", "  ".join(f"{z:.2f}" for z in v)]
            elif key == "bias":
                out += [f"{name:<9}= {len(v)}", *[f"Parametr = {b:.3f}" for b in v]]
            else:
                out.append(f"{name:<9}= {v}")
        return "\n".join(out) + "\n"

    @classmethod
    def load(cls, path: str) -> Inputs:
        """The file's settings; without one, the defaults are written to it first."""
        import os

        if not os.path.exists(path):
            with open(path, "w") as f:
                f.write(cls().text())
        with open(path) as f:
            return cls.parse(f.read())


def parse_seeds(text: str) -> list[tuple[int, int]]:
    """(seed, n) of a table of seeds, after its header line."""
    return [(int(a), int(b)) for a, b in (x.split()[:2] for x in text.splitlines()[1:] if x.strip())]


#: Letters of catalogs by overdensity.
OVERDENSITY_LETTERS = {0: "W", 1: "V", 2: "M", 3: "A"}


@dataclass
class FinderSettings:
    """Settings of the finder by keyword, in one of a keyword's spellings; lines with other keywords are passed over."""

    overdensity: int = 1
    shells: int = 30
    energy_bins: int = 0
    extension: float = 0.15
    slope: float = 0.2
    least_mass: float = 2.5e12
    step_radius: float = 0.02
    step_profile: float = 0.02

    # The spellings of each keyword, as the file has them.
    SPELLINGS = {
        "overdensity": ("iVirial", "IVIRIAL", "ivirial"),
        "shells": ("NradP", "NRADP", "nradp"),
        "energy_bins": ("Nne", "NNE", "nne"),
        "extension": ("Rext", "Rextr", "Rextern"),
        "slope": ("SlopeR", "Sloper", "Slope"),
        "least_mass": ("MassMin", "MinMass", "massmin"),
        "step_radius": ("dLogR", "DLOGR", "dlogr"),
        "step_profile": ("dLogP", "DLOGP", "dlogp"),
    }

    @classmethod
    def parse(cls, text: str) -> FinderSettings:
        out = cls()
        names = {s: name for name, spellings in cls.SPELLINGS.items() for s in spellings}
        for line in text.splitlines():
            key, sign, value = line.split("!")[0].partition("=")
            if sign and (name := names.get(key.strip())):
                setattr(out, name, type(getattr(out, name))(first_value(value)))
        return out

    def text(self) -> str:
        notes = {"overdensity": "0: 200 critical, 1: virial, 2: 200 mean, 3: corrected virial", "shells": "shells of profiles", "extension": "radius added", "slope": "slope of the radius added", "least_mass": "least mass", "step_radius": "log step of potentials", "step_profile": "log step of profiles"}
        return "! finder\n" + "".join(f"{'':10}{self.SPELLINGS[n][0]:<9} = {getattr(self, n)!s:>10}   ! {note}\n" for n, note in notes.items())

    @classmethod
    def load(cls, path: str) -> FinderSettings:
        """The file's settings; without one, the defaults are written to it first."""
        import os

        if not os.path.exists(path):
            with open(path, "w") as f:
                f.write(cls().text())
        with open(path) as f:
            return cls.parse(f.read())

    @property
    def letter(self) -> str:
        return OVERDENSITY_LETTERS[self.overdensity]


def parse_table(text: str) -> tuple[dict, list[tuple[float, float]]]:
    """Header pairs and rows (k, P) of a tabulated spectrum; rows whose log spacing strays over 2 % raise ValueError."""
    from math import log

    pairs, rows = parse_pairs(text), []
    for line in text.splitlines():
        if re.match(NUMBER, line):
            k, p = line.split()[:2]
            rows.append((float(k), float(p)))
    steps = [log(b[0] / a[0]) for a, b in zip(rows, rows[1:], strict=False)]
    if steps and max(abs(s / (sum(steps) / len(steps)) - 1) for s in steps) > 0.02:
        raise ValueError("the table's steps in ln k aren't equal")
    return pairs, rows
