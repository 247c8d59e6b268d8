"""Settings that the domain's queries share with their SQL twins."""

#: Seed of all draws, and share of random variants.
SEED, RANDOM_SHARE = 7, 0.000001
#: Secret under which unmapped reads are ciphered.
SECRET = b"\xff" * 16
#: Range of absolute indices that the range queries read.
RANGE = (200_000_000, 900_000_000)
#: Ranges by name: of reads, and of difference records.
NAMED_RANGE, RECORD_RANGE = "chr1:200000000:chr3:90000000", "chrM:1000:chrM:9000"
#: Whole contigs, so that no read of the range has a variant beyond it.
UNMASK_RANGE = "chr19:1:chrM:16575"
