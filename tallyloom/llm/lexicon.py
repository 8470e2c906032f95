"""Function words of scripts without blanks: what a sentence ends with, opens with, goes on after, and can't open with.

The lists hold common words of the languages; forms that follow a rule (conjugations, particles in a row, demonstratives before units of time) are built from it. Callers may pass lists
of their own, see ``Lexicon``.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

# Japanese ---------------------------------------------------------------------------------------------------------------------
JA_POLITE = "ます ました ません ませんでした ましょう です でした でしょう ください なさい ございます".split()
JA_PLAIN = "た だ だった る ない なかった たい たかった である であった だろう いる いた れる れた られる られた せる せた する した なる なった ある あった らしい ようだ そうだ はずだ べきだ のだ んだ".split()
JA_PARTICLES_AT_END = "か ね よ よね な なあ わ ぞ ぜ さ かな かしら".split()
JA_JOINING = (
    "は が を に へ と で の も や から まで より だけ しか ばかり ほど くらい ぐらい など こそ さえ すら とか なら ので のに けど けれど けれども ながら つつ て って たり し ば たら れば には では とは にも でも へは からは までに "
    "について に対して によって として にとって のため という といった における および または あるいは".split()
)
JA_OPENING = (
    "しかし また そして ただし だから そこで それで それから それに なお つまり すると ところが ところで さらに しかも たとえば 例えば 一方 他方 なぜなら それでも だが でも では さて したがって 従って ちなみに 実は 実際 もし もちろん "
    "やはり おそらく たぶん 確かに 特に 私 僕 俺 彼 彼女 彼ら 我々 私たち 皆 誰 何 なぜ どうして いつ どこ この その あの これ それ あれ ここ そこ あそこ こう そう ああ 今 今日 明日 昨日 今朝 今夜 今年 昨年 来年 今月 先月 来月 "
    "今週 先週 来週 最近 当時 翌日 翌朝 やがて まず 次に 最後に 最初に 同時に 突然 すぐに ある 各 全て すべて 多く 第".split()
)
JA_CANNOT_OPEN = "は が を に へ の も や から まで より と って ね よ ので のに けど ます です た て っ ー".split()
# Chinese ----------------------------------------------------------------------------------------------------------------------
ZH_FINAL = "吗 呢 吧 啊 呀 啦 嘛 哦 呗 罢了 而已 为止 来着".split()
ZH_WEAK_FINAL = "了 过 完 好 的 没有 不行 可以 一样".split()
ZH_JOINING = "和 与 或 及 把 被 给 向 从 对 在 是 而 且 但 并 为 以 于 之 比 跟 让 使 将 的 地 得 就 才 也 都 还 很 更 最 不 没 因为 由于 如果 虽然 以及 或者 还是 关于 对于 根据".split()
ZH_PERSONS = "我 你 您 他 她 它 咱 人".split()
ZH_POINTING = "这 那 哪 每 某 各 本 上 下 同".split()
ZH_UNITS = "个 些 里 边 样 种 次 时 位 天 年 月 周 段 批 家 项 条 点 份 名".split()
ZH_OPENING = (
    "但 但是 可是 不过 然而 而且 并且 因此 所以 因为 由于 如果 虽然 尽管 即使 只要 只有 除非 于是 然后 接着 此外 另外 同时 总之 例如 比如 首先 其次 最后 其实 当然 也许 可能 或许 显然 据说 按 按照 根据 随着 关于 对于 至于 为了 "
    "在 自从 当 我 你 您 他 她 它 大家 有人 谁 什么 为什么 怎么 今天 明天 昨天 今年 去年 明年 现在 目前 最近 后来 以后 之后 从前 早上 晚上 上午 下午 这 那 这里 那里 请 第 所有 许多 一些 有些 全部 其中 其他 除了 经过 通过".split()
)
ZH_CANNOT_OPEN = "了 吗 呢 吧 的 地 得 着 过 们 啊 呀 嘛".split()
# Thai -------------------------------------------------------------------------------------------------------------------------
TH_POLITE = "ครับ ครับผม ค่ะ คะ ค่า จ้ะ จ้า".split()
TH_SOFTENING = "นะ สิ ซิ ล่ะ หรอก เถอะ เลย แล้ว ด้วย ไหม หรือ".split()
TH_FINAL = "แล้ว เท่านั้น หรือไม่ หรือเปล่า หรือยัง ไหม มั้ย ด้วย เลย เสมอ กัน นี้ นั้น อยู่ ไว้ ได้ มาก ทุกวัน อีก".split()
TH_JOINING = "ที่ ซึ่ง อัน ของ และ หรือ กับ แต่ ใน จาก เพื่อ ว่า ให้ เป็น คือ โดย แก่ แด่ ต่อ ด้วยการ เพราะ เนื่องจาก ถ้า หาก เมื่อ ระหว่าง การ ความ ไม่ จะ กำลัง ได้แก่ เช่น".split()
TH_PERIODS = "วัน สัปดาห์ อาทิตย์ เดือน ปี ไตรมาส ครั้ง รอบ".split()
TH_POINTING = "นี้ นั้น หน้า ก่อน ที่แล้ว ต่อมา เดียวกัน".split()
TH_OPENING = (
    "แต่ และ ถ้า หาก เพราะ เนื่องจาก ดังนั้น เพราะฉะนั้น อย่างไรก็ตาม นอกจากนี้ นอกจากนั้น ต่อมา จากนั้น หลังจากนั้น เมื่อ ขณะที่ ขณะนี้ ใน หลัง หลังจาก ก่อน ก่อนที่ ตาม ตามที่ สำหรับ โดย ทั้งนี้ อีกทั้ง แม้ แม้ว่า ถึงแม้ ผม ฉัน ดิฉัน "
    "เขา เธอ เรา พวกเขา พวกเรา มัน ท่าน คุณ ใคร อะไร ทำไม เมื่อไร วันนี้ เมื่อวาน พรุ่งนี้ ตอนนี้ ปัจจุบัน ล่าสุด มี บาง ทุก ทั้งหมด การ ความ ผู้ นาย นาง คน".split()
)
TH_CANNOT_OPEN = "ครับ ค่ะ คะ นะ ๆ ฯ ล่ะ หรอก".split()
# --------------------------------------------------------------------------------------------------------------------------------------------


class Lexicon:
    """The words of one script, with what each says of a gap before or after it.

    ``after`` maps a word to its weight as the last one before a gap (2: ends nothing but sentences, 1: often ends one, -2: goes on), ``before`` as the first one after it (1: opens
    sentences, -2: can't open one). All words together are the dictionary of the lattice.
    """

    def __init__(self, strong: Iterable[str], weak: Iterable[str], joining: Iterable[str], opening: Iterable[str], cannot_open: Iterable[str]) -> None:
        self.after = {**dict.fromkeys(joining, -2.0), **dict.fromkeys(weak, 1.0), **dict.fromkeys(strong, 2.0)}
        self.before = {**dict.fromkeys(opening, 1.0), **dict.fromkeys(cannot_open, -2.0)}
        self.by_first: dict[str, list[str]] = {}
        for w in sorted({*self.after, *self.before}):
            self.by_first.setdefault(w[0], []).append(w)

    def segment(self, run: str) -> list[str]:
        """The cheapest path through the word lattice of ``run``: a dictionary word costs 1, any other character 2; of equal paths the one whose last word is longest."""
        n = len(run)
        cost, came = [0] + [1 << 60] * n, [0] * (n + 1)
        for i in range(n):
            c = cost[i]
            if c + 2 < cost[i + 1]:
                cost[i + 1], came[i + 1] = c + 2, i
            for w in self.by_first.get(run[i], ()):
                j = i + len(w)
                if c + 1 < (cost[j] if j <= n else 0) and run.startswith(w, i):
                    cost[j], came[j] = c + 1, i
        out, end = [], n
        while end:
            out.append(run[came[end] : end])
            end = came[end]
        return out[::-1]


def joined(*parts: Iterable[str]) -> list[str]:
    """Every word that takes one part from each list."""
    return ["".join(p) for p in product(*parts)]


JAPANESE = Lexicon(
    strong=JA_POLITE + joined(JA_POLITE, JA_PARTICLES_AT_END) + joined(JA_PLAIN, "か ね よ よね かな".split()),
    weak=JA_PLAIN + ["か", "ね", "よ", "い", "う", "く"],
    joining=JA_JOINING,
    opening=JA_OPENING + joined("この その あの".split(), "ため 後 時 日 場合 結果 間 うち 中 上 ような".split()),
    cannot_open=JA_CANNOT_OPEN,
)
CHINESE = Lexicon(
    strong=ZH_FINAL + joined(ZH_WEAK_FINAL, ZH_FINAL),
    weak=ZH_WEAK_FINAL,
    joining=[w for w in ZH_JOINING if w not in ZH_WEAK_FINAL],
    opening=ZH_OPENING + joined(ZH_PERSONS, ["们"]) + joined(ZH_POINTING, ZH_UNITS),
    cannot_open=ZH_CANNOT_OPEN,
)
THAI = Lexicon(
    strong=TH_POLITE + joined(TH_SOFTENING, TH_POLITE) + ["เท่านั้น", "หรือไม่", "หรือเปล่า", "หรือยัง"],
    weak=TH_FINAL + joined(TH_PERIODS, TH_POINTING),
    joining=TH_JOINING,
    opening=TH_OPENING + joined(TH_PERIODS, TH_POINTING),
    cannot_open=TH_CANNOT_OPEN,
)
