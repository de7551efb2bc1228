"""Column types shared by all modules. Coordinates are 0-based and half-open, [start, end)."""

BLOCKS = "array<struct<s:bigint,e:bigint>>"
INTERVAL = "chrom string, start bigint, end bigint, name string, strand string"
TRANSCRIPT = f"{INTERVAL}, blocks {BLOCKS}, thick struct<s:bigint,e:bigint>, score double, color string"
FEATURE = "chrom string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes map<string,string>"
VARIANT = "chrom string, start bigint, end bigint, name string, strand string, ref string, alts array<string>, qual int, filt string, info map<string,string>"
READ = "qname string, flag int, chrom string, start bigint, mapq int, cigar string, next_chrom string, next_start bigint, tlen bigint, seq string, qual string, tags map<string,string>"
EVENTS = "array<struct<pos:bigint,ref:string,alt:string,qual:array<int>,dist:bigint>>"
