"""Domain-invariant encoder: a shared and a private code, task heads, domain discriminators and a decoder, in numpy."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import argmax, c, num
from .arrow import map_arrow


class Dense:
    """Linear layers with ReLU between them, gradients and Adam."""

    def __init__(self, sizes: list[int], rng: np.random.Generator) -> None:
        bound = [1 / np.sqrt(a) for a in sizes[:-1]]
        self.w = [rng.uniform(-b, b, (m, n)) for b, m, n in zip(bound, sizes, sizes[1:], strict=False)]
        self.b = [rng.uniform(-b, b, n) for b, n in zip(bound, sizes[1:], strict=True)]
        self.reset()

    def reset(self) -> None:
        self.g = [np.zeros_like(p) for p in (*self.w, *self.b)]

    def forward(self, x: np.ndarray, last_relu: bool = False) -> tuple[np.ndarray, list]:
        saved = []
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = x @ w + b
            relu = i < len(self.w) - 1 or last_relu
            saved.append((x, z, relu))
            x = np.maximum(z, 0) if relu else z
        return x, saved

    def backward(self, d: np.ndarray, saved: list) -> np.ndarray:
        n = len(self.w)
        for i in range(n - 1, -1, -1):
            x, z, relu = saved[i]
            d = d * (z > 0) if relu else d
            self.g[i] += x.T @ d
            self.g[n + i] += d.sum(axis=0)
            d = d @ self.w[i].T
        return d

    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.b]


class Adam:
    def __init__(self, nets: list[Dense], rate: float, decay: float, beta1: float) -> None:
        self.nets, self.rate, self.decay, self.beta1, self.t = nets, rate, decay, beta1, 0
        self.m = [[np.zeros_like(p) for p in n.parameters()] for n in nets]
        self.v = [[np.zeros_like(p) for p in n.parameters()] for n in nets]

    def step(self) -> None:
        self.t += 1
        for k, net in enumerate(self.nets):
            for i, p in enumerate(net.parameters()):
                g = net.g[i] + self.decay * p
                self.m[k][i] = self.beta1 * self.m[k][i] + (1 - self.beta1) * g
                self.v[k][i] = 0.9 * self.v[k][i] + 0.1 * g * g
                p -= self.rate * (self.m[k][i] / (1 - self.beta1**self.t)) / (np.sqrt(self.v[k][i] / (1 - 0.9**self.t)) + 1e-8)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cross_entropy(logits: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    p = softmax(logits)
    rows = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[rows, y], 1e-300)).mean())
    p[rows, y] -= 1
    return loss, p / len(y)


def orthogonality(s: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean squared cosine of the two codes, and its gradients."""
    ns, np_ = (np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (s, p))
    us, up = s / ns, p / np_
    cos = (us * up).sum(axis=1, keepdims=True)
    k = 2 * cos / len(s)
    return float((cos**2).mean()), k * (up - cos * us) / ns, k * (us - cos * up) / np_


class EarlyStopping:
    """Stops after `patience` epochs without improvement by more than `delta`; a loss as low as the best starts the count again."""

    def __init__(self, patience: int = 10, delta: float = 0.0) -> None:
        self.patience, self.delta = patience, delta
        self.reset()

    def reset(self) -> None:
        self.best, self.count, self.stop = None, 0, False

    def __call__(self, loss: float) -> bool:
        if self.best is None or loss <= self.best - self.delta:
            self.best, self.count = loss, 0
        else:
            self.count += 1
            self.stop = self.count >= self.patience
        return self.stop


class Encoder:
    """See fit; every predictive method works on arrays, and apply() on DataFrames."""

    def __init__(self, input_dim: int, latent_dim: int = 16, shared_dim: int | None = None, private_dim: int | None = None, num_tasks: tuple[int, ...] = (2,), num_domains: tuple[int, ...] = (2,), hidden_dims: tuple[int, ...] = (64, 32), reconstruction_weight: float = 0.1, adversarial_weight: float = 1.0, orthogonality_weight: float = 0.1, learning_rate: float = 0.01, learning_rate_g: float | None = None, learning_rate_d: float | None = None, weight_decay: float = 1e-4, weight_decay_g: float | None = None, weight_decay_d: float | None = None, batch_size: int = 128, d_steps_per_g_step: int = 1, beta1: float = 0.5, random_state: int | None = None) -> None:
        self.params = {k: (list(v) if isinstance(v, tuple) else v) for k, v in locals().items() if k != "self"}
        self.shared = shared_dim if shared_dim is not None else latent_dim // 2
        self.private = private_dim if private_dim is not None else latent_dim // 2
        if self.shared != self.private:
            raise ValueError("the shared and the private code must be of the same size")
        self.rng = np.random.default_rng(random_state)
        self.tasks, self.domains = list(num_tasks), list(num_domains)
        h = list(hidden_dims)
        self.base = Dense([input_dim, *h], self.rng)
        self.to_shared, self.to_private = Dense([h[-1], self.shared], self.rng), Dense([h[-1], self.private], self.rng)
        self.decoder = Dense([self.shared + self.private, *h[::-1], input_dim], self.rng)
        self.heads = [Dense([self.shared, n], self.rng) for n in self.tasks]
        self.discriminators = [Dense([self.shared, *h[::-1], n], self.rng) for n in self.domains]
        self.weights = reconstruction_weight, adversarial_weight, orthogonality_weight
        self.generator = [self.base, self.to_shared, self.to_private, self.decoder, *self.heads]
        first = lambda a, b: a if a is not None else b
        self.opt_g = Adam(self.generator, first(learning_rate_g, learning_rate), first(weight_decay_g, weight_decay), beta1)
        self.opt_d = Adam(self.discriminators, first(learning_rate_d, learning_rate), first(weight_decay_d, weight_decay), beta1)
        self.batch, self.d_steps, self.updates = batch_size, d_steps_per_g_step, 0
        self.history: list[dict] = []

    def _codes(self, x: np.ndarray) -> tuple:
        base, sb = self.base.forward(x, last_relu=True)
        s, ss = self.to_shared.forward(base)
        p, sp = self.to_private.forward(base)
        return s, p, (sb, ss, sp)

    def losses(self, x: np.ndarray, tasks: np.ndarray, domains: np.ndarray, which: str) -> dict:
        """Forward and backward of a discriminator's or a generator's step; gradients are left in the nets."""
        for net in (*self.generator, *self.discriminators):
            net.reset()
        s, p, saved = self._codes(x)
        adversarial, ds = 0.0, np.zeros_like(s)
        for i, net in enumerate(self.discriminators):
            out, keep = net.forward(s)
            loss, d = cross_entropy(out, domains[:, i])
            adversarial += loss
            ds += net.backward(d, keep)
        if which == "discriminator":
            return {"disc_loss": adversarial, "step_type": which}
        rec_w, adv_w, orth_w = self.weights
        ds *= -adv_w
        classifier = 0.0
        for i, net in enumerate(self.heads):
            out, keep = net.forward(s)
            loss, d = cross_entropy(out, tasks[:, i])
            classifier += loss
            ds += net.backward(d, keep)
        out, keep = self.decoder.forward(np.hstack([s, p]))
        rec = float(((out - x) ** 2).mean())
        d = self.decoder.backward(rec_w * 2 * (out - x) / x.size, keep)
        orth, gs, gp = orthogonality(s, p)
        ds += d[:, : self.shared] + orth_w * gs
        dp = d[:, self.shared :] + orth_w * gp
        self.base.backward(self.to_shared.backward(ds, saved[1]) + self.to_private.backward(dp, saved[2]), saved[0])
        return {"gen_loss": classifier - adv_w * adversarial + rec_w * rec + orth_w * orth, "classifier_loss": classifier, "reconstruction_loss": rec, "orthogonal_loss": orth, "disc_loss": adversarial, "step_type": which}

    def step(self, x: np.ndarray, tasks: np.ndarray, domains: np.ndarray) -> dict:
        """Discriminators learn on d_steps of every 1 + d_steps updates, the others on the rest."""
        self.updates += 1
        which = "discriminator" if self.updates % (1 + self.d_steps) < self.d_steps else "generator"
        out = self.losses(x, tasks, domains, which)
        (self.opt_d if which == "discriminator" else self.opt_g).step()
        return out

    def fit(self, x: np.ndarray, tasks: np.ndarray, domains: np.ndarray, validation: tuple | None = None, max_epochs: int = 100, patience: int | None = None) -> Encoder:
        """Shuffled batches, the last short one left out; stops early on the first task's validation loss."""
        x, tasks, domains = np.asarray(x, float), np.asarray(tasks).reshape(len(x), -1), np.asarray(domains).reshape(len(x), -1)
        stop = EarlyStopping(patience) if patience else None
        size = min(self.batch, len(x))
        for _ in range(max_epochs):
            order = self.rng.permutation(len(x))
            steps = [self.step(x[i], tasks[i], domains[i]) for i in (order[a : a + size] for a in range(0, len(x) - size + 1, size))]
            row = {k: float(np.mean([s[k] for s in steps if k in s])) for k in ("gen_loss", "classifier_loss", "disc_loss", "reconstruction_loss", "orthogonal_loss") if any(k in s for s in steps)}
            if validation is not None:
                logits = self.heads[0].forward(self._codes(np.asarray(validation[0], float))[0])[0]
                row["val_loss"] = cross_entropy(logits, np.asarray(validation[1]).reshape(len(logits), -1)[:, 0])[0]
            self.history.append(row)
            if stop and "val_loss" in row and stop(row["val_loss"]):
                break
        return self

    def predict_tasks_proba(self, x: np.ndarray) -> list[np.ndarray]:
        s = self._codes(np.asarray(x, float))[0]
        return [softmax(n.forward(s)[0]) for n in self.heads]

    def predict_tasks(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([p.argmax(axis=1) for p in self.predict_tasks_proba(x)])

    def predict_domains_proba(self, x: np.ndarray) -> list[np.ndarray]:
        s = self._codes(np.asarray(x, float))[0]
        return [softmax(n.forward(s)[0]) for n in self.discriminators]

    def predict_domains(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([p.argmax(axis=1) for p in self.predict_domains_proba(x)])

    def embed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, p, _ = self._codes(np.asarray(x, float))
        return s, p

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        return self.decoder.forward(np.hstack(self.embed(x)))[0]

    def to_bytes(self) -> bytes:
        """Parameters and weights; arrays and JSON only, nothing that runs when it is read."""
        out = io.BytesIO()
        nets = [*self.generator, *self.discriminators]
        np.savez(out, params=np.array(json.dumps(self.params)), **{f"{k}_{i}": p for k, n in enumerate(nets) for i, p in enumerate(n.parameters())})
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Encoder:
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            params = json.loads(str(z["params"]))
            model = Encoder(**{k: (tuple(v) if isinstance(v, list) else v) for k, v in params.items()})
            for k, net in enumerate([*model.generator, *model.discriminators]):
                for i, p in enumerate(net.parameters()):
                    p[...] = z[f"{k}_{i}"]
        return model


OUTPUT = [("shared", T.ArrayType(T.DoubleType())), ("private", T.ArrayType(T.DoubleType())), ("tasks", T.ArrayType(T.IntegerType())), ("domains", T.ArrayType(T.IntegerType())), ("domain_entropy", T.ArrayType(T.DoubleType())), ("reconstruction_error", T.DoubleType())]


def apply(df: DataFrame, columns: list[str], model: Encoder) -> DataFrame:
    """Adds shared and private codes, predicted tasks and domains, the entropy of each domain's prediction and the mean squared
    reconstruction error. Rows with a null input have nulls. Rows stay in place; the model's size is fixed by its layers."""
    names = df.columns
    wide = df.select(*[c(n) for n in names], *[num(df, n).alias(f"_x{i}") for i, n in enumerate(columns)])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in OUTPUT]])
    shared = df.sparkSession.sparkContext.broadcast(model.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Encoder.from_bytes(shared.value)
        for batch in batches:
            x = np.column_stack([batch.column(len(names) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))]) if batch.num_rows else np.zeros((0, len(columns)))
            fine = ~np.isnan(x).any(axis=1)
            out: list[list] = [[None] * len(x) for _ in OUTPUT]
            if fine.any():
                at, v = np.flatnonzero(fine), x[fine]
                s, p = net.embed(v)
                proba = net.predict_domains_proba(v)
                entropy = np.column_stack([-(q * np.log(np.maximum(q, 1e-300))).sum(axis=1) for q in proba])
                for k, values in enumerate((s, p, net.predict_tasks(v), net.predict_domains(v), entropy, ((net.reconstruct(v) - v) ** 2).mean(axis=1))):
                    for i, value in zip(at.tolist(), values.tolist(), strict=True):
                        out[k][i] = value
            kinds = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *[pa.array(o, k) for o, k in zip(out, kinds, strict=True)]], names=schema.names)

    return map_arrow(wide, run, schema)


def principal_components(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """df with `pca`: scores on the first k components of the covariance (one aggregate; the projection is arithmetic)."""
    row = df.agg(*[F.avg(num(df, n)).alias(f"m{i}") for i, n in enumerate(columns)], *[F.covar_samp(num(df, a), num(df, b)).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    d = len(columns)
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    v = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    scores = [sum(((num(df, n) - float(row[f"m{i}"] or 0.0)) * float(v[i, j]) for i, n in enumerate(columns)), F.lit(0.0)) for j in range(v.shape[1])]
    return df.withColumn("pca", F.array(*scores))


def feature_errors(df: DataFrame, columns: list[str], reconstructed: list[str]) -> DataFrame:
    """(column, mse): mean squared difference of each feature and its reconstruction, in one aggregate."""
    wide = df.agg(*[F.avg((num(df, a) - num(df, b)) ** 2).alias(f"_{i}") for i, (a, b) in enumerate(zip(columns, reconstructed, strict=True))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_{i}").alias("mse")) for i, n in enumerate(columns)])).alias("r")).select("r.*")


def logistic_accuracy(df: DataFrame, codes: str, label: str, test: DataFrame | None = None) -> float:
    """How well a logistic regression tells a label from codes (an array column): fitted on df, measured on test (or df)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    ready = lambda d: d.where(c(codes).isNotNull() & c(label).isNotNull()).select(array_to_vector(c(codes)).alias("features"), c(codes).cast("array<double>").alias("codes"), c(label).cast("string").alias("name"))
    index = StringIndexer(inputCol="name", outputCol="label", handleInvalid="skip").fit(ready(df))
    model = LogisticRegression(maxIter=50).fit(index.transform(ready(df)))
    # Margins as expressions: the model's own transform takes the session along, which can't be sent once rows have been observed in it.
    margins = [F.aggregate(F.zip_with("codes", F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w), F.lit(float(b)), lambda s, v: s + v) for row, b in zip(model.coefficientMatrix.toArray(), model.interceptVector.toArray(), strict=True)]
    predicted = F.when(margins[0] > 0, 1).otherwise(0) if len(margins) == 1 else argmax(margins)
    rows = index.transform(ready(test if test is not None else df)).withColumn("prediction", predicted.cast("double"))
    return rows.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
