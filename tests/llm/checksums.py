import zlib


def crc_of(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
