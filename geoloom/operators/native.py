"""The sampler's inner loops in Java, for ``mixture``.

Spark brings a Java compiler and every executor a Java machine: the driver compiles ``_SOURCE`` once (``compiled``), the code
goes to the tasks with their function, and a Python worker starts one small Java process of its own (``ready``) that it
talks to by pipes; the process ends with the worker.  A cluster that is empty has the prior's statistics, so its parts of a
draw are computed once for all of them.  Where Java can't be started ``mixture`` runs the same steps in numpy, with the
same random numbers.
"""

from __future__ import annotations

import atexit
import os
import shutil
import subprocess
import tempfile

import numpy as np
from pyspark.sql import SparkSession

_SOURCE = r"""
import java.io.*;
import java.nio.*;

public class GeoloomSampler {
    static final DataInputStream in = new DataInputStream(new BufferedInputStream(System.in, 1 << 16));
    static final byte[] part = new byte[1 << 16];
    static final ByteBuffer view = ByteBuffer.wrap(part).order(ByteOrder.LITTLE_ENDIAN);
    static double[] table;
    static double low, scale, fixed;
    static final double[] LN = new double[4096], INV = new double[4096], EXP = new double[4096];

    static double[] read(double[] a, int n) throws IOException {
        for (int i = 0; i < n; ) {
            int m = Math.min(n - i, part.length / 8);
            in.readFully(part, 0, 8 * m);
            ((Buffer) view).clear();
            view.asDoubleBuffer().get(a, i, m);
            i += m;
        }
        return a;
    }

    static double[] read(int n) throws IOException {
        return read(new double[n], n);
    }

    static void write(OutputStream out, double[] a) throws IOException {
        for (int i = 0; i < a.length; ) {
            int m = Math.min(a.length - i, part.length / 8);
            ((Buffer) view).clear();
            view.asDoubleBuffer().put(a, i, m);
            out.write(part, 0, 8 * m);
            i += m;
        }
    }

    /** ln x of a normal positive number, to the last digits but one. */
    static double ln(double x) {
        long b = Double.doubleToRawLongBits(x);
        int i = (int) (b >>> 40) & 4095;
        double r = Double.longBitsToDouble((b & 0xFFFFFFFFFFFFFL) | 0x3FF0000000000000L) * INV[i] - 1;
        return (((int) (b >>> 52)) - 1023) * 0.6931471805599453 + (LN[i] + r * (1 - r * (0.5 - r * (0.3333333333333333 - 0.25 * r))));
    }

    /** e to the x, -700 < x <= 0, to the last digits but one. */
    static double exp(double x) {
        double n = x * 5909.278887481194;
        int i = (int) n - 1;
        double r = (n - i) * 1.6922538587889289E-4;
        return EXP[i & 4095] * Double.longBitsToDouble((long) ((i >> 12) + 1023) << 52) * (1 + r * (1 + r * (0.5 + r * (0.16666666666666666 + r * 0.041666666666666664))));
    }

    static double norm(double lk, double k, double front) {
        double at = (lk - low) * scale;
        int i = (int) at;
        double t = at - i;
        i *= 4;
        return front * lk - k - (table[i] + t * (table[i + 1] + t * (table[i + 2] + t * table[i + 3]))) - fixed;
    }

    public static void main(String[] args) throws IOException {
        PrintStream out = System.out;
        for (int i = 0; i < 4096; i++) {
            double c = 1 + (i + 0.5) / 4096;
            INV[i] = 1 / c;
            LN[i] = -Math.log(INV[i]);
            EXP[i] = Math.pow(2, i / 4096.0);
        }
        double[] head = new double[20];
        while (true) {
            try {
                read(head, 20);
            } catch (EOFException e) {
                return;
            }
            if (head[0] == 0) {
                low = head[1];
                scale = head[2];
                fixed = head[3];
                table = read((int) head[4]);
                continue;
            }
            run(head, out);
            out.flush();
        }
    }

    static int h, dim, nonempty;
    static boolean places, logs;
    static double alpha, lambda0, nu0, virtual, delta0, c0, width, least, most, front, prior2;
    static final double TINY = Math.log(1e-8);
    static double[] prior, s, length2, kappa, count, place, own, weight, lk, lc, now, lp, half;

    static void run(double[] q, OutputStream out) throws IOException {
        int n = (int) q[3], mode = (int) q[4], sweeps = (int) q[6], steps = (int) q[7];
        h = (int) q[1];
        dim = (int) q[2];
        places = q[5] > 0;
        logs = q[8] > 0;
        alpha = q[9];
        lambda0 = q[10];
        nu0 = q[11];
        virtual = q[12];
        delta0 = q[13];
        c0 = q[14];
        width = q[15];
        least = q[16];
        most = q[17];
        front = dim / 2.0 - 0.5;
        prior = read(dim);
        s = read(h * dim);
        length2 = read(h);
        kappa = read(h);
        count = read(h);
        place = read(5 * h);
        own = read(h);
        weight = read(h);
        double[] x = read(n * dim), d = places ? read(2 * n) : null, z = read(n), u = new double[n], normal = new double[steps * h], bar = new double[steps * h];
        lk = new double[h];
        lc = new double[h];
        now = new double[h];
        lp = new double[h];
        half = new double[h];
        prior2 = 0;
        for (int j = 0; j < dim; j++) prior2 += prior[j] * prior[j];
        nonempty = 0;
        for (int k = 0; k < h; k++) {
            if (count[k] >= 0.01) nonempty++;
            half[k] = (nu0 + 1 + count[k]) / 2;
        }
        for (int sweep = 0; sweep < sweeps; sweep++) {
            if (mode < 2) {
                read(u, n);
                for (int k = 0; k < h; k++) {
                    lk[k] = Math.log(kappa[k]);
                    lc[k] = norm(Math.max(lk[k], TINY), kappa[k], front);
                    now[k] = norm(Math.max(lk[k] + 0.5 * ln(length2[k]), TINY), kappa[k] * Math.sqrt(length2[k]), front);
                }
            }
            for (int i = 0; i < n; i++) {
                double a = places ? d[2 * i] : 0, b = places ? d[2 * i + 1] : 0;
                if (mode == 0 || mode == 3) put(x, i * dim, a, b, (int) z[i], -1);
                if (mode < 2) z[i] = draw(x, i * dim, a, b, u[i]);
                if (mode != 3) put(x, i * dim, a, b, (int) z[i], 1);
            }
            if (steps > 0) {
                read(normal, steps * h);
                read(bar, steps * h);
                for (int k = 0; k < h; k++) kappa[k] = walk(k, steps, normal, bar);
            }
        }
        double[][] all = new double[][] {s, length2, kappa, count, place, own, weight, z};
        for (int i = 0; i < all.length; i++) write(out, all[i]);
    }

    static double dot(double[] s, int row, double[] x, int at, int dim) {
        int j = 0;
        double t = 0, t1 = 0, t2 = 0, t3 = 0;
        for (; j + 3 < dim; j += 4) {
            t += s[row + j] * x[at + j];
            t1 += s[row + j + 1] * x[at + j + 1];
            t2 += s[row + j + 2] * x[at + j + 2];
            t3 += s[row + j + 3] * x[at + j + 3];
        }
        for (; j < dim; j++) t += s[row + j] * x[at + j];
        return t + t1 + t2 + t3;
    }

    /** What clusters weigh for a row, as ln, into lp; the largest. */
    static double weigh(double[] x, int at, double a, double b, double[] lp) {
        int h = GeoloomSampler.h, dim = GeoloomSampler.dim;
        double[] s = GeoloomSampler.s, length2 = GeoloomSampler.length2, kappa = GeoloomSampler.kappa, count = GeoloomSampler.count, place = GeoloomSampler.place, own = GeoloomSampler.own, weight = GeoloomSampler.weight, lk = GeoloomSampler.lk, lc = GeoloomSampler.lc, now = GeoloomSampler.now, half = GeoloomSampler.half;
        double front = GeoloomSampler.front, tiny = TINY, vv = dot(x, at, x, at, dim), e2 = Math.max(prior2 + 2 * dot(x, at, prior, 0, dim) + vv, 1e-300), er = Math.sqrt(e2), el = 0.5 * ln(e2);
        double more = Math.log((virtual - nonempty + 0.01) / (h - nonempty + 0.01)), top = -1e308;
        boolean places = GeoloomSampler.places;
        if (places) {
            double w = lambda0 / (lambda0 + 1), p = delta0 + w * a * a, r = delta0 + w * b * b, c = w * a * b;
            more -= (nu0 + 1) / 2 * Math.log(Math.max(p * r - c * c, 1e-300));
        }
        for (int k = 0; k < h; k++) {
            double v = own[k] + lc[k] + now[k];
            if (count[k] < 0.01) {
                v += more - norm(Math.max(lk[k] + el, tiny), kappa[k] * er, front);
            } else {
                double l2 = Math.max(length2[k] + 2 * dot(s, k * dim, x, at, dim) + vv, 1e-300);
                v -= norm(Math.max(lk[k] + 0.5 * ln(l2), tiny), kappa[k] * Math.sqrt(l2), front);
                if (places) {
                    double e = a - place[k], f = b - place[h + k], w = weight[k];
                    double p = place[2 * h + k] + w * e * e, r = place[4 * h + k] + w * f * f, c = place[3 * h + k] + w * e * f;
                    v -= half[k] * ln(Math.max(p * r - c * c, 1e-300));
                }
            }
            lp[k] = v;
            if (v > top) top = v;
        }
        return top;
    }

    static int draw(double[] x, int at, double a, double b, double u) {
        double[] lp = GeoloomSampler.lp;
        double top = weigh(x, at, a, b, lp), total = 0, sum = 0;
        int h = GeoloomSampler.h, k = 0;
        for (int i = 0; i < h; i++) {
            lp[i] = lp[i] - top < -40 ? 0 : exp(lp[i] - top);
            total += lp[i];
        }
        for (; k < h - 1; k++) {
            sum += lp[k];
            if (sum >= u * total) break;
        }
        return k;
    }

    static void put(double[] x, int at, double a, double b, int k, double sign) {
        double[] s = GeoloomSampler.s, place = GeoloomSampler.place;
        int dim = GeoloomSampler.dim, row = k * dim;
        double held = lambda0 + count[k], e = count[k] + sign, t = 0;
        nonempty += (e >= 0.01 ? 1 : 0) - (count[k] >= 0.01 ? 1 : 0);
        if (e < 0.01) {
            System.arraycopy(prior, 0, s, row, dim);
            t = prior2;
            if (places) {
                place[k] = place[h + k] = place[3 * h + k] = 0;
                place[2 * h + k] = place[4 * h + k] = delta0;
            }
        } else {
            for (int j = 0; j < dim; j++) s[row + j] += sign * x[at + j];
            t = dot(s, row, s, row, dim);
            if (places) {
                double y = place[k], w = place[h + k], g;
                if (sign < 0) {
                    y = (y * held - a) / (held - 1);
                    w = (w * held - b) / (held - 1);
                    g = -(held - 1) / held;
                } else g = held / (held + 1);
                double p = a - y, r = b - w;
                if (sign > 0) {
                    y += p / (held + 1);
                    w += r / (held + 1);
                }
                place[k] = y;
                place[h + k] = w;
                place[2 * h + k] += g * p * p;
                place[3 * h + k] += g * p * r;
                place[4 * h + k] += g * r * r;
            }
        }
        length2[k] = t;
        count[k] = e;
        half[k] = (nu0 + 1 + e) / 2;
        own[k] = Math.log(alpha + e);
        if (places) {
            double o = nu0 + e, r = place[2 * h + k] * place[4 * h + k] - place[3 * h + k] * place[3 * h + k];
            own[k] += Math.log((e + lambda0) / (e + 1 + lambda0)) + o / 2 * Math.log(Math.max(r, 1e-300)) + Math.log((o - 1) / 2);
            weight[k] = (lambda0 + e) / (lambda0 + e + 1);
        }
        now[k] = norm(Math.max(lk[k] + 0.5 * ln(Math.max(t, 1e-300)), TINY), kappa[k] * Math.sqrt(t), front);
    }

    /** kappa of a cluster after its steps. */
    static double walk(int k, int steps, double[] normal, double[] bar) {
        int h = GeoloomSampler.h;
        boolean logs = GeoloomSampler.logs;
        double width = GeoloomSampler.width, least = GeoloomSampler.least, most = GeoloomSampler.most, front = GeoloomSampler.front, tiny = TINY;
        double length = Math.sqrt(length2[k]), ll = Math.log(Math.max(length, 1e-300)), l = Math.log(kappa[k]), kap = kappa[k], w = logs ? l : kap, c = c0 + count[k];
        double worth = c * norm(l, kap, front) - norm(Math.max(l + ll, tiny), kap * length, front);
        for (int t = k; t < steps * h; t += h) {
            double to = w + width * normal[t];
            to = to < least ? 2 * least - to : to > most ? 2 * most - to : to;
            to = to < least ? least : to > most ? most : to;
            double nk = logs ? Math.exp(to) : to, nl = logs ? to : ln(to);
            double v = c * norm(nl, nk, front) - norm(Math.max(nl + ll, tiny), nk * length, front);
            if (-bar[t] < v - worth) {
                w = to;
                worth = v;
                kap = nk;
            }
        }
        return kap;
    }
}
"""

_PROCESS: list[subprocess.Popen | None] = []


def compiled(spark: SparkSession) -> dict[str, bytes] | None:
    """{class: code} by the compiler that Spark uses itself, or None."""
    try:
        c = spark._jvm.org.codehaus.janino.SimpleCompiler()
        c.cook(_SOURCE)
        return {k: bytes(v) for k, v in c.getBytecodes().items()}
    except Exception:  # noqa: BLE001  any failure of the gateway means the slower loops, not a failed job
        return None


def ready(code: dict[str, bytes] | None) -> None:
    """Starts this worker's Java process, if it has none and can have one."""
    if _PROCESS and (_PROCESS[0] is None or _PROCESS[0].poll() is None) or not code:
        return
    _PROCESS.clear()
    home = os.environ.get("JAVA_HOME")
    java = os.path.join(home, "bin", "java") if home else shutil.which("java")
    try:
        folder = tempfile.mkdtemp(prefix="geoloom-")
        for name, b in code.items():
            with open(os.path.join(folder, name + ".class"), "wb") as f:
                f.write(b)
        run = subprocess.Popen([java or "java", "-Xmx1g", "-Xss1m", "-XX:+UseSerialGC", "-XX:ActiveProcessorCount=1", "-cp", folder, "GeoloomSampler"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=1 << 16)
    except OSError:
        _PROCESS.append(None)
        return
    run.table = None
    _PROCESS.append(run)
    atexit.register(stop)
    atexit.register(shutil.rmtree, folder, True)


def stop() -> None:
    """Ends this worker's process; the next ``ready`` starts another."""
    if _PROCESS and _PROCESS[0] is not None:
        _PROCESS[0].stdin.close()
        _PROCESS[0].wait()
    _PROCESS.clear()


def running() -> bool:
    return bool(_PROCESS) and _PROCESS[0] is not None


def send(*arrays: np.ndarray) -> None:
    for a in arrays:
        _PROCESS[0].stdin.write(np.ascontiguousarray(a, dtype="<f8").data.cast("B") if a.size else b"")


def use_table(dim: int, grid: list[float], table: np.ndarray) -> None:
    if _PROCESS[0].table != dim:
        send(np.array([0, *grid, table.size] + [0] * 15, dtype=float), table)
        _PROCESS[0].table = dim


def receive(*sizes: int) -> list[np.ndarray]:
    _PROCESS[0].stdin.flush()
    out = []
    for n in sizes:
        raw = _PROCESS[0].stdout.read(8 * n)
        if len(raw) < 8 * n:
            raise RuntimeError("the sampler's Java process ended")
        out.append(np.frombuffer(raw, dtype="<f8").astype(float))
    return out
